"""sources of the behaviour-log engine."""
