"""Operators: every one maps DataFrames to a DataFrame."""
