"""Continuous runs over arriving files."""
