"""Tidemark: retrieval and operations analytics on Spark DataFrames."""
