"""Operators composed to whole queries."""
