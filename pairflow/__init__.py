"""Paired time-series analytics on Spark DataFrames."""
