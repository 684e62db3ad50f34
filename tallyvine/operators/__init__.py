"""Operators over DataFrames: each takes tables and returns a table."""
