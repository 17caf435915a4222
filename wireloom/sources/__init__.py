"""Readers and fixed dimension tables."""
