"""quipu: associative-memory analytics over weighted concept graphs, on Spark DataFrames."""

__version__ = "0.1.0"
