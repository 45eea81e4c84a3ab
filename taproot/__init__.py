"""Whole-program reachability and dataflow analytics on Spark DataFrames."""

__version__ = "0.3.0"
