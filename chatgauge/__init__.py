"""Chat-classification data preparation, scoring and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
