"""Streams into a table, each batch in one commit and once only; and the changes since a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snaptable.operators.snapshot import raw_versions
from snaptable.table import Table


def write_stream(stream: DataFrame, table: Table, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
    """Loads a stream's rows batch by batch. A batch that is already in the log is not loaded again."""
    mark = name or table.name

    def load(rows: DataFrame, batch: int) -> None:
        if batch > table.db.log.marks.get(mark, -1):  # batches of a stream come in order
            table.load(rows, stream=[mark, batch])

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changes_since(table: Table, commit: int) -> DataFrame:
    """The versions that later commits brought, folds aside, with their commit numbers."""
    parts = [p for p in table.db.txns.seen(table.number, table.db.log.last) if p.n > commit]
    found = raw_versions(table.db.spark, table.schema, parts)
    return found.select("__key", "__seq", "__gone", "__commit", *[F.col(f"f{i}").alias(c.name) for i, c in enumerate(table.schema.columns)])
