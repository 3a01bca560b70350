"""Batch operators, each from DataFrames to DataFrames."""
