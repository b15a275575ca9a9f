"""Batch operators. Each takes and returns DataFrames."""
