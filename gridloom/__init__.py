"""Dense matrix and N-dimensional array analytics on PySpark DataFrames."""

__version__ = "0.1.0"
