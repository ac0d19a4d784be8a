"""Retrieval and evaluation engine on Spark DataFrames."""
