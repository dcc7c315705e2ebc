"""wordmill: a Spark-first text-mining engine (DataFrames in, DataFrames out)."""

__version__ = "0.1.0"
