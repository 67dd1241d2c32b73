"""Operators of the query algebra over DataFrames."""
