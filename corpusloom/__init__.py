"""Hybrid document retrieval and training-data operations on Spark DataFrames."""
