"""Annotation-track analytics on Spark DataFrames."""
