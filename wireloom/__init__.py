"""Wireloom: drawing netlists as Spark tables."""
