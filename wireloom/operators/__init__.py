"""Operators over tables keyed by drawing."""
