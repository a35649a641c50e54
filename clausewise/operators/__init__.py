"""Operators: each takes and returns DataFrames, for all questions at once."""
