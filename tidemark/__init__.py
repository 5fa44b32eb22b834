"""Spark-native memory and retrieval analytics on DataFrames."""

__version__ = "0.1.0"
