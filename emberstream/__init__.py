"""Streaming clustering and outlier scoring on Spark DataFrames."""
