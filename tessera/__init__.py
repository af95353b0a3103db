"""Indexed text search over files as DataFrames."""
