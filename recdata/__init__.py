"""Spark operators for recommendation data: plain functions from DataFrames to a DataFrame."""
