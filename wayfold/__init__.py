"""Scheduled-movement and map-geometry analytics on Spark DataFrames."""
