"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: ASCII white space as the query contracts define it: x20 and x09 to x0D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in this process (tests) is a temporary folder set; on a
    cluster that would be a folder of the driver alone, so there it is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="snaptable-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/snaptable/{uuid.uuid4().hex}/{name}"


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, frame: DataFrame) -> None:
    """Deletes the folder of a frame that ``written`` returned, once nothing reads it any more."""
    for name in frame.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows in an Arrow batch: whole texts make batches large, and each is held several times on its way.
BATCH_ROWS = 1000

_kept: dict[str, object] = {}


def worker_keeps(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, made on first use: one thing at a time.

    Workers go on from one operator to the next; what the last one kept is let go first."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every system has it
            ctypes.CDLL(None).malloc_trim(0)
        _kept[name] = make()
    return _kept[name]


_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once per application, and bounds Arrow batches.

    Frames are evaluated after a function has returned, so the bound stays in the session; a caller's
    smaller one is kept."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="snaptable-ship-")
    path = os.path.join(folder, "snaptable_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, dirs, names in os.walk(top):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    out.write(full, os.path.join(os.path.basename(top), os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may fetch it at any time
    _shipped[app] = path


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *stems: str) -> Iterator[str]:
    """A name for each stem that is none of ``taken``, in either case of letters."""
    used = {t.lower() for t in taken}
    for stem in stems:
        name = stem
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        yield name


def rows_where(docs: DataFrame, column: str, test: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` that pass a test of a batch's values of one column, all columns as they are.

    ``test`` is called once in each task. Columns go by their places, whatever their names."""
    at = docs.columns.index(column)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def text_of(column: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an identifier's text, modulo; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(named(column).cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def least_count(frame: DataFrame, column: str, most: int) -> int | None:
    """The least count whose rows, with all of higher counts, are no more than ``most``; None if there is none."""
    cut, taken = None, 0
    for level in frame.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc(column)).toLocalIterator():
        taken += level["rows"]
        if taken > most:
            break
        cut = level[column]
    return cut


#: Rows of a key-only table that are sent to every executor; larger ones are joined by a shuffle.
SMALL_ROWS = 100_000


def counted(frame: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast only if its counted rows are at most SMALL_ROWS."""
    return F.broadcast(frame) if frame.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else frame


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """Joins rows with a table of one row for each key, whose column ``n`` (dropped) counts the key's rows, ``total`` in all.

    Fewer than 1,000 keys can hold over a thousandth of all rows each: those are broadcast, and their rows
    are dealt by ``spread`` instead, so no key makes a task. ``how`` is left or inner; rows and table share
    the key columns only, and keys are not null."""
    values = [c for c in table.columns if c not in (*keys, n)]
    hot, here, deal = fresh([*rows.columns, *table.columns], "hot", "here", "deal")
    many = named(n) * 1000 > F.lit(total)
    few = table.filter(many).select(*[named(k) for k in keys], F.struct(F.lit(True).alias(here), *[named(v) for v in values]).alias(hot))
    seen = rows.join(F.broadcast(few), keys, "left").withColumn(deal, F.when(F.col(hot).isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(0))
    rest = table.filter(~many).select(*[named(k).alias(f"{hot}{i}") for i, k in enumerate(keys)], F.struct(F.lit(True).alias(here), *[named(v) for v in values]).alias(here))
    same = F.col(deal) == F.col(f"{deal}0")
    for i, k in enumerate(keys):
        same &= seen[f"`{k}`"] == rest[f"{hot}{i}"]
    met = seen.join(rest.withColumn(f"{deal}0", F.lit(0).cast("bigint")), same, "left")
    found = F.coalesce(F.col(hot), F.col(here))
    out = met.select(*[seen[f"`{c}`"] for c in rows.columns], *[found.getField(v).alias(v) for v in values], found.isNotNull().alias(deal))
    return (out.filter(F.col(deal)) if how == "inner" else out).drop(deal)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value once for a body that uses it several times, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]
