"""Spatial statistics on Spark DataFrames."""
