"""Operators: each takes DataFrames and returns a DataFrame, and starts no action."""
