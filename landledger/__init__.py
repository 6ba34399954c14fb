"""Listing memory and ranking on Spark DataFrames."""
