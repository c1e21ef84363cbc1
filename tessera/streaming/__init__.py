"""Continuous import into databases."""
