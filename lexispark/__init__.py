"""Positional text search and corpus analytics on Spark DataFrames."""
