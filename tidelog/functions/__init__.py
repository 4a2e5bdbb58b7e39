"""functions of the behaviour-log engine."""
