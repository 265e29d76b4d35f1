"""Strata: code analytics and collection analytics on PySpark DataFrames."""

__version__ = "0.1.0"
