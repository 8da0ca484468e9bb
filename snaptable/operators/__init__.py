"""Reads and writes over versioned tables, as DataFrames."""
