"""tensorloom: named, typed, n-dimensional arrays and corpus data as Spark DataFrames."""

__version__ = "0.1.0"
