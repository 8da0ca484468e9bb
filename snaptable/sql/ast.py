"""Statements as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str  # = != < <= > >=
    literal: str


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary_key: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...]  # empty: all
    where: Condition | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Condition | None = None


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, str], ...]
    where: Condition | None = None


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


Statement = CreateTable | Insert | Select | Delete | Update | Begin | Commit | Rollback
