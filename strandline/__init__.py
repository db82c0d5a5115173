"""Analytics over message archives and the knowledge derived from them, on Spark DataFrames."""

__version__ = "0.1.0"
