"""Integers out of stored text, and typed comparisons of columns with literals."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from snaptable import fixed

OPERATORS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}

_LEADING = r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)"
_NUMBER = re.compile(_LEADING)


class NotANumber(ValueError):
    def __init__(self):
        super().__init__(fixed.NOT_A_NUMBER)


def integer(text: str) -> int:
    """The 64-bit number that a text begins with; blanks before and anything after it are passed over."""
    m = _NUMBER.match(text)
    if m is None or not -(1 << 63) <= int(m.group(1)) < 1 << 63:
        raise NotANumber
    return int(m.group(1))


def integer_column(text: Column) -> Column:
    """``integer`` for a column; a row without a number fails the query, and only if it is looked at."""
    digits = F.regexp_extract(text, _LEADING, 1)
    return F.coalesce(digits.try_cast("bigint"), F.raise_error(F.lit(fixed.NOT_A_NUMBER)).cast("bigint"))


def compare(column: Column, op: str, value: int | str) -> Column:
    return OPERATORS[op](column, F.lit(value))
