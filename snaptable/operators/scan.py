"""Ordered reads over a typed key column, for any DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(frame: DataFrame, column: str, key) -> DataFrame:
    return frame.filter(F.col(column) == F.lit(key))


def range_scan(frame: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose key lies between two keys, both included, in order; keys that occur twice come twice."""
    return frame.filter(F.col(column).between(F.lit(low), F.lit(high))).orderBy(column)


def ordered(frame: DataFrame, column: str) -> DataFrame:
    return frame.orderBy(column)
