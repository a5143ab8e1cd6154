"""Impression-log analytics as Spark DataFrame operators."""
