"""Structured Streaming into and out of tables."""
