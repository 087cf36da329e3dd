"""Spark-native analytics for interferometric observations held as DataFrames."""

__version__ = "0.1.0"
