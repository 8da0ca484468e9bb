"""The catalog: table names, numbers and columns, kept as JSON and replaced in one step."""

from __future__ import annotations

import json
import os
import threading
from dataclasses import dataclass
from pathlib import Path

from snaptable import fixed


class CatalogError(Exception):
    pass


@dataclass(frozen=True)
class Column:
    name: str
    type: str


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]

    @classmethod
    def of(cls, *columns: tuple[str, str]) -> Schema:
        """From (name, type) pairs; types are ``int`` and ``string`` in either case."""
        found = []
        for name, kind in columns:
            if kind.lower() not in fixed.TYPES:
                raise CatalogError(fixed.UNKNOWN_TYPE.format(kind))
            if name in (c.name for c in found):
                raise CatalogError(f"duplicate column: {name}")
            found.append(Column(name, kind.lower()))
        if not found:
            raise CatalogError("a table needs a column")
        return cls(tuple(found))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def place(self, name: str) -> int:
        """A column's place; names are case-sensitive."""
        for i, c in enumerate(self.columns):
            if c.name == name:
                return i
        raise CatalogError(fixed.NO_COLUMN.format(name))

    def dumped(self) -> list[list[str]]:
        return [[c.name, c.type] for c in self.columns]


class Catalog:
    def __init__(self, folder: Path):
        self.path = folder / "catalog.json"
        self.lock = threading.Lock()
        self.tables: dict[str, tuple[int, Schema]] = {}
        if self.path.exists():
            for name, number, columns in json.loads(self.path.read_text()):
                self.tables[name] = (number, Schema.of(*columns))

    def create(self, name: str, schema: Schema) -> int:
        with self.lock:
            if name in self.tables:
                raise CatalogError(fixed.TABLE_EXISTS.format(name))
            number = 1 + max((n for n, _ in self.tables.values()), default=-1)
            after = self.tables | {name: (number, schema)}
            part = self.path.with_suffix(".part")
            with part.open("w") as file:
                json.dump([[k, n, s.dumped()] for k, (n, s) in after.items()], file)
                file.flush()
                os.fsync(file.fileno())
            os.replace(part, self.path)
            self.tables = after
            return number

    def get(self, name: str) -> tuple[int, Schema]:
        if name not in self.tables:
            raise CatalogError(fixed.NOT_IN_CATALOG.format(name))
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def names(self) -> list[str]:
        return sorted(self.tables)
