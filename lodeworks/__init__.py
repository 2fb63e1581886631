"""Lodeworks: retrieval-augmented analytics over institutional text, on Spark DataFrames."""
