"""Catalog matching and recommendation on Spark DataFrames."""
