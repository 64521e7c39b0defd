"""Operators over ordered recordings, each a function from DataFrames to a DataFrame."""
