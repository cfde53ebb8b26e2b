"""civicframe: panel building and regression on Spark DataFrames."""

__version__ = "0.1.0"
