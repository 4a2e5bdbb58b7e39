"""plans of the behaviour-log engine."""
