"""Training-data operators: scans, filters, models and writers for large text corpora.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; ``queries.py`` holds the thin registered queries.
"""
