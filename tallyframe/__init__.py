"""tallyframe: measured cleaning, joining and cross-filtered metrics on Spark DataFrames."""

__version__ = "0.1.0"
