"""streaming of the behaviour-log engine."""
