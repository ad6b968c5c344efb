"""Tidemark: causal time-series analytics and rule engines on Spark DataFrames."""
