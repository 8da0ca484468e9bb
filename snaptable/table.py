"""The embedded API of one table. The first column is the key; rows are texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaptable import fixed
from snaptable.functions.lenient import OPERATORS, integer
from snaptable.operators import snapshot
from snaptable.operators.snapshot import View
from snaptable.sources.catalog import Schema
from snaptable.sql.ast import Condition
from snaptable.txn.manager import Transaction

if TYPE_CHECKING:
    from snaptable.database import Database

ROW_BY_ROW = 1000  # most rows that a statement changes through the log; more become a file
FOLD_ROWS = 20_000  # logged rows of a table after which they are folded into a base
FOLD_FILES = 64  # change files after which they are; or sooner, once they hold more rows than the base


class TableError(Exception):
    pass


class Table:
    def __init__(self, db: Database, name: str, number: int, schema: Schema):
        self.db, self.name, self.number, self.schema = db, name, number, schema

    def begin(self) -> Transaction:
        return self.db.begin()

    def commit(self, txn: Transaction) -> None:
        self.db.commit(txn)

    def abort(self, txn: Transaction) -> None:
        self.db.abort(txn)

    def dump(self) -> list[str]:
        """The newest stored version of each key, deleted or not, a line each; for looking at small tables."""
        newest = self.versions().groupBy("__key").agg(F.max_by(F.struct("__gone", "__seq", *self.schema.names), "__seq").alias("r")).orderBy("__key")
        return [f"{r[0]} @{r.r['__seq']}{' deleted' if r.r['__gone'] else ''}: {'|'.join(str(r.r[c]) for c in self.schema.names)}" for r in newest.collect()]

    # Reading ---------------------------------------------------------------------------------

    def view(self, txn: Transaction | None = None, latest: bool = False) -> View:
        """What a transaction sees: the commits up to its snapshot and its own changes; without one, all commits."""
        upto = self.db.log.last if txn is None or latest else txn.snapshot
        parts = self.db.txns.seen(self.number, upto)
        own = txn.writes.get(self.number) if txn else None
        return View(self.schema, [*parts, own] if own else parts)

    def raw(self, txn: Transaction | None = None) -> DataFrame:
        """``__key``, the text ``f{i}`` of each column and the number ``n{i}`` of each int column."""
        return snapshot.visible(self.db.spark, self.view(txn))

    def frame(self, txn: Transaction | None = None) -> DataFrame:
        """The visible rows with their column names, ints as BIGINT, without an order."""
        return self.raw(txn).select(
            *[F.col(f"n{i}" if c.type == "int" else f"f{i}").alias(c.name) for i, c in enumerate(self.schema.columns)]
        )

    def versions(self) -> DataFrame:
        """Every committed version as stored, with no regard to visibility."""
        found = snapshot.raw_versions(self.db.spark, self.schema, self.db.txns.seen(self.number, self.db.log.last))
        names = [F.col(f"f{i}").alias(c.name) for i, c in enumerate(self.schema.columns)]
        before = F.lag("__seq").over(Window.partitionBy("__key").orderBy("__seq"))
        return found.select("__key", "__seq", before.alias("__prev_seq"), "__gone", "__commit", *names)

    def _at_hand(self, upto: int, txn: Transaction | None) -> bool:
        """Whether keys can be looked up without a Spark job."""
        own = txn.writes.get(self.number) if txn else None
        chains = self.db.txns.chains[self.number]
        return not (own and (own.files or own.base)) and upto >= chains.since

    def _change(self, key: str, upto: int) -> tuple[int, int, list[str] | None] | None:
        """The newest change of a key since the base, in the log or in a file: commit, sequence number, fields."""
        chains = self.db.txns.chains[self.number]
        found = chains.newest(key, upto)
        for n, seq, file in reversed(chains.files):
            if n <= upto and (found is None or (n, seq) > found[:2]):
                row = self.db.points.find(file["files"], key)
                if row is not None:
                    found = (n, seq, None if row[1] else row[2:])
        return found

    def _key_row(self, key: str, txn: Transaction | None, latest: bool = False) -> list[str] | None:
        upto = self.db.log.last if txn is None or latest else txn.snapshot
        own = txn.own[self.number].get(key) if txn else None
        if not self._at_hand(upto, txn):
            view = self.view(txn, latest)
            row = snapshot.visible(self.db.spark, view, key).head()
            return [row[f"f{i}"] for i in range(len(self.schema.columns))] if row else None
        if own:
            return own[2]
        found = self._change(key, upto)
        if found:
            return found[2]
        base = self.db.txns.chains[self.number].base
        row = self.db.points.find(base["files"], key) if base else None
        return None if row is None else _texts(row)

    def range_by_key(self, low: str, high: str, txn: Transaction | None = None) -> list[tuple[str, list[str]]]:
        """(key, texts) of the visible rows whose key's text lies between two, both included, in byte order.

        Without a Spark job where single keys need none; meant for short ranges, for all of it is held here."""
        upto = self.db.log.last if txn is None else txn.snapshot
        if not self._at_hand(upto, txn):
            found = self.raw(txn).filter(F.col("__key").between(F.lit(low), F.lit(high))).orderBy("__key")
            return [(r["__key"], [r[f"f{i}"] for i in range(len(self.schema.columns))]) for r in found.collect()]
        chains = self.db.txns.chains[self.number]
        base = self.db.points.between(chains.base["files"], low, high) if chains.base else []
        own = {k: r[2] for k, r in txn.own[self.number].items() if low <= k <= high} if txn else {}
        if not chains.files and not chains.keys and not own:
            return [(k, _texts(r)) for k, r in base]
        rows = {k: _texts(r) for k, r in base}
        newest: dict[str, tuple[int, int, list[str] | None]] = {}
        for n, seq, file in chains.files:
            if n <= upto:
                for k, r in self.db.points.between(file["files"], low, high):
                    if k not in newest or newest[k][:2] < (n, seq):
                        newest[k] = (n, seq, None if r[1] else list(r[2:]))
        for k in chains.between(low, high):
            found = chains.newest(k, upto)
            if found and (k not in newest or newest[k][:2] < found[:2]):
                newest[k] = found
        rows |= {k: v[2] for k, v in newest.items()} | own
        return sorted((k, f) for k, f in rows.items() if f is not None)

    def get_by_key(self, key: str, txn: Transaction | None = None) -> list[str] | None:
        """The visible row of a key, matched as text; None if there is none."""
        return self._key_row(key, txn)

    def _small(self, txn: Transaction | None) -> list[tuple[str, list[str]]] | None:
        """All visible rows in byte order of their keys, if only the log holds any; else None."""
        upto = self.db.log.last if txn is None else txn.snapshot
        chains = self.db.txns.chains[self.number]
        if chains.base or chains.files or not self._at_hand(upto, txn):
            return None
        rows = {}
        for key in list(chains.keys):
            if found := chains.newest(key, upto):
                rows[key] = found[2]
        if txn:
            rows |= {k: r[2] for k, r in txn.own[self.number].items()}
        return sorted(((k, f) for k, f in rows.items() if f is not None), key=lambda r: r[0].encode())

    def _matches(self, condition: Condition | None) -> Callable[[list[str]], bool]:
        """The condition as a test of one row; an int that can't be read fails when it is met."""
        if condition is None:
            return lambda fields: True
        i, op = self.schema.place(condition.column), OPERATORS[condition.operator]
        if self.schema.columns[i].type == "int":
            return lambda fields: op(integer(fields[i]), integer(condition.literal))
        literal = condition.literal.encode()
        return lambda fields: op(fields[i].encode(), literal)

    def _is_key(self, condition: Condition | None) -> bool:
        return condition is not None and condition.operator == "=" and self.schema.place(condition.column) == 0

    def matching(self, condition: Condition | None, txn: Transaction | None) -> DataFrame:
        """The visible rows that meet a condition; equality with the key compares texts."""
        if self._is_key(condition):
            return snapshot.visible(self.db.spark, self.view(txn), condition.literal)
        found = self.raw(txn)
        if condition is None:
            return found
        return found.filter(snapshot.predicate(self.schema, condition.column, condition.operator, condition.literal))

    def rows(self, condition: Condition | None = None, txn: Transaction | None = None) -> Iterator[tuple[str, list[str]]]:
        """(key, texts) of the rows that meet a condition, in byte order of their keys.

        From files they come a partition at a time, so the driver holds no whole result."""
        if condition is not None:
            self.schema.place(condition.column)
        if self._is_key(condition):
            row = self.get_by_key(condition.literal, txn)
            if row is not None:
                yield condition.literal, row
            return
        small = self._small(txn)
        if small is not None:
            test = self._matches(condition)
            yield from [(k, f) for k, f in small if test(f)]
            return
        texts = [f"f{i}" for i in range(len(self.schema.columns))]
        for r in self.matching(condition, txn).select("__key", *texts).orderBy("__key").toLocalIterator(prefetchPartitions=True):
            yield r[0], list(r[1:])

    def select(self, condition: Condition | None = None, txn: Transaction | None = None) -> list[tuple[str, list[str]]]:
        """``rows`` as a list."""
        return list(self.rows(condition, txn))

    def scan_all(self, txn: Transaction | None = None) -> list[tuple[str, list[str]]]:
        return self.select(None, txn)

    # Writing ---------------------------------------------------------------------------------

    @contextmanager
    def _within(self, txn: Transaction | None) -> Iterator[Transaction]:
        """The given transaction, or one of its own that commits at the end and is dropped on an error."""
        if txn is not None:
            yield self.db.txns.get(txn.id)
            return
        own = self.db.begin()
        try:
            yield own
        except BaseException:
            self.db.abort(own)
            raise
        self.db.commit(own)
        self._fold_if_due()

    def _fold_if_due(self) -> None:
        """Folds once the log or the change files hold much; a fold costs a base, so the work stays in proportion."""
        chains = self.db.txns.chains[self.number]
        if chains.size > FOLD_ROWS or len(chains.files) > FOLD_FILES or (chains.base and chains.filed > max(FOLD_ROWS, chains.base["rows"])):
            self.db.fold(self)

    def _check(self, values: Sequence[str], message: str) -> list[str]:
        if len(values) != len(self.schema.columns):
            raise TableError(message)
        return [str(v) for v in values]

    def insert(self, values: Sequence[str], txn: Transaction | None = None) -> None:
        """Adds a row, or a new version of the row with its key; waits for another writer of that key."""
        if not values:
            raise TableError(fixed.NO_VALUES)
        fields = self._check(values, fixed.INSERT_COUNT)
        with self._within(txn) as t:
            self.db.locks.acquire((self.number, fields[0]), t.id)
            t.write(self.number, fields[0], self.db.txns.next_seq(), fields)

    def _rewrite_key(self, key: str, txn: Transaction, new: Callable[[list[str]], list[str] | None]) -> bool:
        """Locks a key, reads its newest row again, and writes what becomes of it; False if it is gone."""
        self.db.locks.acquire((self.number, key), txn.id)
        now = self._key_row(key, txn, latest=True)
        if now is None:
            return False
        txn.write(self.number, key, self.db.txns.next_seq(), new(now))
        return True

    def update_by_key(self, key: str, values: Sequence[str], txn: Transaction | None = None) -> bool:
        fields = self._check(values, fixed.UPDATE_COUNT)
        with self._within(txn) as t:
            return self._key_row(key, t) is not None and self._rewrite_key(key, t, lambda _: fields)

    def delete_by_key(self, key: str, txn: Transaction | None = None) -> bool:
        with self._within(txn) as t:
            return self._key_row(key, t) is not None and self._rewrite_key(key, t, lambda _: None)

    def update_where(self, assignments: Mapping[str, str], condition: Condition | None = None, txn: Transaction | None = None) -> int:
        """Sets columns of the matching rows; the number of rows. The key that a row is found by stays."""
        places = {self.schema.place(c): v for c, v in assignments.items()}

        def new(now: list[str]) -> list[str]:
            return [places.get(i, v) for i, v in enumerate(now)]

        return self._rewrite(condition, txn, new, {f"f{i}": F.lit(v) for i, v in places.items()})

    def delete_where(self, condition: Condition | None = None, txn: Transaction | None = None) -> int:
        return self._rewrite(condition, txn, lambda _: None, None)

    def _rewrite(self, condition, txn, new, columns) -> int:
        if condition is not None:
            self.schema.place(condition.column)
        with self._within(txn) as t:
            keys = self._few_keys(condition, t)
            if keys is not None:
                return sum(self._rewrite_key(k, t, new) for k in keys)
            return self._rewrite_bulk(condition, t, columns)

    def _few_keys(self, condition: Condition | None, txn: Transaction) -> list[str] | None:
        if self._is_key(condition) or self._small(txn) is not None:
            return [k for k, _ in self.select(condition, txn)]
        # Where a key's newest row can't be looked up at hand, a job for each row would be slower than one file.
        most = ROW_BY_ROW if self._at_hand(self.db.log.last, txn) else 0
        rows = self.matching(condition, txn).select("__key").limit(most + 1).collect()
        return sorted((r[0] for r in rows), key=str.encode) if len(rows) <= most else None

    def _rewrite_bulk(self, condition: Condition | None, txn: Transaction, columns: dict | None) -> int:
        """Many rows: the table is locked, and the changed rows become a file that the commit names."""
        spark = self.db.spark
        self.db.locks.acquire((self.number, None), txn.id)
        matched = self.matching(condition, txn)
        if any(p.n > txn.snapshot for p in self.db.txns.parts[self.number]):
            # Others have committed since: the rows as they are now, of the keys that matched.
            matched = snapshot.visible(spark, self.view(txn, latest=True)).join(matched.select("__key"), "__key", "left_semi")
        seq = self.db.txns.next_seq()
        texts = [f"f{i}" for i in range(len(self.schema.columns))]
        if columns is None:
            out = [F.lit(None).cast("string").alias(c) for c in texts]
        else:
            out = [columns.get(c, F.col(c)).alias(c) for c in texts]
        gone = F.lit(columns is None).alias("__gone")
        return self._write_changes(matched.select("__key", F.lit(seq).cast("bigint").alias("__seq"), gone, *out), seq, txn)

    def _write_changes(self, changes: DataFrame, seq: int, txn: Transaction) -> int:
        """Writes one row for each changed key, in sorted ranges of keys like a base, so that single keys are found in them."""
        path = self.db.data_path(self.number, txn)
        changes.repartitionByRange("__key").sortWithinPartitions("__key").write.option("parquet.block.size", 16 << 20).parquet(path)
        files = self._files(self.db.spark.read.schema(changes.schema).parquet(path))[0]
        n = sum(f["rows"] for f in files)
        if n:
            txn.writes[self.number].files.append({"path": path, "rows": n, "seq": seq, "files": files})
        return n

    @staticmethod
    def _files(stored: DataFrame, *more) -> tuple[list[dict], list[dict]]:
        """For each file its name, least and greatest key and rows, in order of keys; and the rows of all further sums."""
        stats = stored.groupBy(F.input_file_name().alias("name")).agg(
            F.min("__key").alias("low"), F.max("__key").alias("high"), F.count(F.lit(1)).alias("rows"), *more
        )
        found = sorted((r.asDict() for r in stats.collect()), key=lambda r: r["low"])  # a row for each file
        return [{k: r[k] for k in ("name", "low", "high", "rows")} for r in found], found

    def load(self, rows: DataFrame, txn: Transaction | None = None, **mark) -> int:
        """Adds the rows of a DataFrame, its columns in the table's order, in one commit.

        Of rows with one key the greatest stays, by its columns in order, numbers as numbers. Integral columns of an int column stay numbers, so
        comparisons reach the Parquet scan. Nulls become empty texts. In an empty table the rows
        become its base, sorted by key; else they are changes, newer than what is there."""
        if len(rows.columns) != len(self.schema.columns):
            raise TableError(fixed.INSERT_COUNT)
        own = txn is None
        t = self.db.begin() if own else self.db.txns.get(txn.id)
        try:
            self.db.locks.acquire((self.number, None), t.id)
            seq = self.db.txns.next_seq()
            named = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
            key = F.coalesce(F.col("c0").cast("string"), F.lit("")).alias("__key")
            if not self.view(t, latest=True).parts:
                base = self.write_base(named.select(key, *named.columns), seq, False, t)
                t.writes[self.number].base = base
                n = base["rows"]
            else:
                newest = named.select(key, F.struct(*self._typed(named)[0]).alias("r")).groupBy("__key").agg(F.max("r").alias("r"))
                texts = [F.coalesce(F.col(f"r.c{i}").cast("string"), F.lit("")).alias(f"f{i}") for i in range(len(named.columns))]
                frame = newest.select("__key", F.lit(seq).cast("bigint").alias("__seq"), F.lit(False).alias("__gone"), *texts)
                n = self._write_changes(frame, seq, t)
        except BaseException:
            if own:
                self.db.abort(t)
            raise
        if own:
            self.db.txns.commit(t, **mark)
            self._fold_if_due()
        return n

    def _typed(self, rows: DataFrame) -> tuple[list[Column], list[bool]]:
        """``c0``... as a base stores them, and whether an int column is stored as text."""
        kept, text = [], []
        for i, c in enumerate(self.schema.columns):
            number = isinstance(rows.schema[f"c{i}"].dataType, T.IntegralType)
            text.append(c.type == "int" and not number)
            kept.append(F.col(f"c{i}").cast("bigint" if c.type == "int" and number else "string").alias(f"c{i}"))
        return kept, text

    def write_base(self, rows: DataFrame, seq: int, folded: bool, txn: Transaction) -> dict:
        """Writes (``__key``, ``c0``...) as a base: one row for each key, in ranges of keys, sorted.

        One shuffle, for rows that are nearly one for each key; rows that repeat a key meet in one task."""
        spark, path = self.db.spark, self.db.data_path(self.number, txn)
        kept, text = self._typed(rows)
        # Ranges of keys hold all rows of a key, so the window needs no shuffle of its own.
        first = Window.partitionBy("__key").orderBy(*[F.desc(f"c{i}") for i in range(len(kept))])
        ranged = rows.select("__key", *kept).repartitionByRange("__key").withColumn("__turn", F.row_number().over(first))
        ranged.filter("__turn = 1").drop("__turn").sortWithinPartitions("__key").write.option("parquet.block.size", 16 << 20).parquet(path)
        gaps = [F.count(F.when(F.col(f"c{i}").isNull(), 1)).alias(f"g{i}") for i in range(len(kept))]
        files, found = self._files(spark.read.parquet(path), *gaps)
        holes = [any(r[f"g{i}"] for r in found) for i in range(len(kept))]
        return {"path": path, "rows": sum(f["rows"] for f in files), "seq": seq, "text": text, "gaps": holes, "files": files, "folded": folded}


def _texts(values: Sequence) -> list[str]:
    return ["" if v is None else str(v) for v in values]
