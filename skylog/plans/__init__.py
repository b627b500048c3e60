"""Registered queries over the given tables."""
