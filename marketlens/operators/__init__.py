"""Operators on listing-market tables: DataFrames in, DataFrames out."""
