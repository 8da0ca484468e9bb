"""Typed keys: 64-bit integers, 32-bit floats or strings; comparing two kinds is an error."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import total_ordering


@total_ordering
@dataclass(frozen=True, eq=False)
class Key:
    value: int | float | str

    def __post_init__(self):
        if isinstance(self.value, bool) or not isinstance(self.value, int | float | str):
            raise TypeError(f"a key is an int, a float or a string, not {type(self.value).__name__}")
        if isinstance(self.value, float):  # as stored: 32 bits
            object.__setattr__(self, "value", struct.unpack("<f", struct.pack("<f", self.value))[0])

    @property
    def kind(self) -> str:
        return {int: "integer", float: "float", str: "string"}[type(self.value)]

    def _order(self, other: Key):
        if not isinstance(other, Key):
            return NotImplemented
        if self.kind != other.kind:
            raise TypeError(f"can't compare a key of kind {self.kind} with one of kind {other.kind}")
        if isinstance(self.value, str):  # by bytes, as Spark's default collation
            return self.value.encode(), other.value.encode()
        return self.value, other.value

    def __eq__(self, other):
        both = self._order(other)
        return both if both is NotImplemented else both[0] == both[1]

    def __lt__(self, other):
        both = self._order(other)
        return both if both is NotImplemented else both[0] < both[1]

    def __hash__(self):
        return hash((self.kind, self.value))

    def __str__(self):
        return str(self.value)
