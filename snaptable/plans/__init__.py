"""Registered queries over the engine."""
