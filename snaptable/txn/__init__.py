"""Commit log, transactions and row locks."""
