"""Ordered time-series analytics on Spark DataFrames."""
