"""Column-level meaning of every operation."""
