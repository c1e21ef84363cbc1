"""Symbolic expressions, query scopes and the compiler to DataFrames."""
