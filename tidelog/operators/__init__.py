"""operators of the behaviour-log engine."""
