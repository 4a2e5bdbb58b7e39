"""Behaviour-log analytics expressed as Spark DataFrame plans."""
