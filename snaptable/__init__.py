"""Transactional, snapshot-isolated tables on Spark, with a small SQL dialect."""
