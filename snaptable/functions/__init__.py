"""Column expressions and keys that Spark has not ready-made."""
