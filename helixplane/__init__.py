"""Probabilistic read-mapping analytics on Spark: DataFrames in, DataFrames out."""
