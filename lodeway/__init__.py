"""Geospatial and routing analytics on Spark DataFrames."""
