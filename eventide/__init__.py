"""Event-series analytics on Spark DataFrames."""
