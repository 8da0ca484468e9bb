"""The rows of a table at a point of the commit log, as a DataFrame.

A table is a base (one row for each key, sorted by key, typed) and the changes after it: change
files, and the few rows that the log itself holds. A snapshot is a choice of these parts, so a read
filters no row for visibility. The newest change of a key wins; keys that changed leave the base
by an anti-join, whose small side is broadcast only while the log says that it is small.

Frames carry ``__key`` and, for column i, its text ``f{i}`` and, if it is an int, its number ``n{i}``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaptable import fixed
from snaptable.functions.lenient import compare, integer, integer_column
from snaptable.sources.catalog import Schema

BROADCAST_KEYS = 100_000  # most changed keys that are sent to every executor

Row = tuple[str, int, list[str] | None]  # key, sequence number, fields (None: deleted)


@dataclass
class Part:
    """What one commit brought to a table."""

    n: int  # the commit's number; 0 while it is not committed
    rows: list[Row] = field(default_factory=list)
    files: list[dict] = field(default_factory=list)  # {path, rows}
    base: dict | None = None  # {path, rows, gaps, files}: takes the place of all before it


@dataclass
class View:
    """The parts that a reader sees, oldest first; own uncommitted ones last."""

    schema: Schema
    parts: list[Part]

    @property
    def base(self) -> dict | None:
        return next((p.base for p in reversed(self.parts) if p.base), None)

    @property
    def after(self) -> list[Part]:
        last = max((i for i, p in enumerate(self.parts) if p.base), default=0)
        return [p for p in self.parts[last:] if p.rows or p.files]  # a part's changes come after its base

    def logged(self) -> dict[str, Row]:
        """The newest change of each key among the rows that the log holds."""
        newest: dict[str, Row] = {}
        for p in self.after:
            for row in p.rows:
                if row[0] not in newest or newest[row[0]][1] <= row[1]:
                    newest[row[0]] = row
        return newest

    def files(self) -> list[dict]:
        return [f for p in self.after for f in p.files]


def change_schema(schema: Schema) -> T.StructType:
    fields = [T.StructField("__key", T.StringType()), T.StructField("__seq", T.LongType()), T.StructField("__gone", T.BooleanType())]
    return T.StructType(fields + [T.StructField(f"f{i}", T.StringType()) for i in range(len(schema.columns))])


def _numbers(schema: Schema, frame: DataFrame) -> DataFrame:
    """Adds the numbers of text fields, read only where a query looks at them."""
    wanted = [i for i, c in enumerate(schema.columns) if c.type == "int"]
    return frame.select("__key", *fields(schema, lambda i: integer_column(F.col(f"f{i}")) if i in wanted else None))


def fields(schema: Schema, number) -> list[Column]:
    out = []
    for i, c in enumerate(schema.columns):
        out.append(F.col(f"f{i}"))
        if c.type == "int":
            out.append(number(i).alias(f"n{i}"))
    return out


def base_frame(spark: SparkSession, schema: Schema, base: dict) -> DataFrame:
    """The base as stored: ints as numbers, so that comparisons reach the Parquet scan."""
    kinds = [T.LongType() if c.type == "int" and not base["text"][i] else T.StringType() for i, c in enumerate(schema.columns)]
    stored = T.StructType([T.StructField("__key", T.StringType()), *[T.StructField(f"c{i}", k) for i, k in enumerate(kinds)]])
    raw = spark.read.schema(stored).parquet(base["path"])
    out = [F.col("__key")]
    for i, c in enumerate(schema.columns):
        col = F.col(f"c{i}")
        typed = isinstance(kinds[i], T.LongType)
        out.append(F.coalesce(col.cast("string"), F.lit("")).alias(f"f{i}") if base["gaps"][i] else col.cast("string").alias(f"f{i}"))
        if c.type == "int":
            if not typed:
                number = integer_column(F.coalesce(col, F.lit("")))
            elif base["gaps"][i]:
                number = F.when(col.isNull(), F.raise_error(F.lit(fixed.NOT_A_NUMBER))).otherwise(col)
            else:
                number = col
            out.append(number.alias(f"n{i}"))
    return raw.select(*out)


def rows_frame(spark: SparkSession, schema: Schema, rows: list[Row]) -> DataFrame:
    width = len(schema.columns)
    data = [(k, s, f is None, *(f if f is not None else [None] * width)) for k, s, f in rows]
    return spark.createDataFrame(data, change_schema(schema))


def visible(spark: SparkSession, view: View, key: str | None = None) -> DataFrame:
    """One row for each key that the view shows; ``key`` restricts it to one, down to the scan."""
    schema, logged, files = view.schema, view.logged(), view.files()
    if key is not None:
        logged = {k: r for k, r in logged.items() if k == key}
    columns = [f"f{i}" for i in range(len(schema.columns))]
    changed = latest = None
    n_changed = len(logged) + sum(f["rows"] for f in files)
    if files:
        changes = spark.read.schema(change_schema(schema)).parquet(*[f["path"] for f in files])
        if logged:
            changes = changes.unionAll(rows_frame(spark, schema, list(logged.values())))
        newest = changes.groupBy("__key").agg(F.max_by(F.struct("__gone", *columns), "__seq").alias("r"))
        changed, latest = newest.select("__key"), newest.filter(~F.col("r.__gone")).select("__key", *[f"r.{c}" for c in columns])
    elif logged:
        frame = rows_frame(spark, schema, sorted(logged.values()))
        changed, latest = frame.select("__key"), frame.filter(~F.col("__gone")).select("__key", *columns)
    latest = _numbers(schema, latest) if latest is not None else None
    if view.base is None:
        out = latest if latest is not None else _numbers(schema, rows_frame(spark, schema, []))
    else:
        out = base_frame(spark, schema, view.base)
        if changed is not None:
            small = F.broadcast(changed) if n_changed <= BROADCAST_KEYS else changed
            out = out.join(small, "__key", "left_anti").unionByName(latest)
    return out if key is None else out.filter(F.col("__key") == key)


def raw_versions(spark: SparkSession, schema: Schema, parts: list[Part]) -> DataFrame:
    """Every stored version, whoever may see it: key, sequence number, whether it deletes, texts, commit number."""
    columns = [f"f{i}" for i in range(len(schema.columns))]
    frames = []
    for at, p in enumerate(parts):
        n = F.lit(p.n).cast("bigint").alias("__commit")
        if p.base and (not p.base["folded"] or not at):  # a fold repeats versions that are still there
            seq = F.lit(p.base["seq"]).cast("bigint").alias("__seq")
            frames.append(base_frame(spark, schema, p.base).select("__key", seq, F.lit(False).alias("__gone"), *columns, n))
        if p.rows:
            frames.append(rows_frame(spark, schema, p.rows).select("*", n))
        for f in p.files:
            frames.append(spark.read.schema(change_schema(schema)).parquet(f["path"]).select("*", n))
    if not frames:
        frames = [rows_frame(spark, schema, []).withColumn("__commit", F.lit(0).cast("bigint"))]
    return reduce(DataFrame.unionAll, frames)


def predicate(schema: Schema, column: str, op: str, literal: str) -> Column:
    """A condition on a frame of ``visible``: ints compare as numbers, strings by bytes."""
    i = schema.place(column)
    if schema.columns[i].type == "int":
        return compare(F.col(f"n{i}"), op, integer(literal))
    return compare(F.col(f"f{i}"), op, literal)
