"""Selections: what a query returns and how rows become Python values."""
