"""The near-duplicates that SimHash links and those that it is too coarse for.

Two texts with a Jaccard similarity of 0.8 differ in about ten of 64 bits, and a Hamming budget that
wide links strangers, so SimHash with its small budget finds close copies only. Here its links are
joined by those of the shingle sets. Equal texts (white space and ASCII case aside) collapse first.
Minima of hashed shingles in bands propose which texts may be alike; all texts that proposals connect form a
group, and within a group every two texts are compared by their whole shingle sets, so what is linked is exact. A
group over ``group_rows``, or of long texts with over ``group_shingles`` in all, is dealt into chunks and every pair of
chunks is a task's group of its own, so what a task holds is bounded. Two texts of
similarity 0.8 share one of the 20 bands with a probability of 0.9996, more alike ones more surely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptable.llm.common import join_hot, named, ship, text_of, worker_keeps, written
from snaptable.llm.simhash import components, links, majority, shingle_hashes

BANDS, ROWS = 20, 5
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def normal(text: str) -> bytes:
    """The words of a text: only A-Z change, only ASCII white space splits."""
    return b" ".join(text.encode().lower().split())


def shingle_set(text: bytes | str, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles; a shorter text is one shingle."""
    return np.unique(shingle_hashes(text.decode() if isinstance(text, bytes) else text, words))


def band_keys(hashes: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * _FACTORS
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) for k in range(BANDS)]


def linked(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """(member, root) of each set that a chain of similar sets connects with an earlier one."""
    sizes = np.array([len(s) for s in sets])
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    inside, rest = np.zeros(len(kinds), dtype=bool), np.arange(len(sets))
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        frontier = [root]
        while frontier and len(rest):
            one = frontier.pop()
            other = sizes[rest]
            able = rest[np.minimum(other, sizes[one]) >= least * np.maximum(other, sizes[one]) - 1e-9]
            if not len(able):
                continue
            inside[parts[one]] = True
            starts = np.cumsum(sizes[able]) - sizes[able]
            shared = np.add.reduceat(inside[np.concatenate([parts[k] for k in able])].astype(np.int64), starts)
            inside[parts[one]] = False
            near = able[shared >= least * (sizes[able] + sizes[one] - shared) - 1e-9]
            frontier += near.tolist()
            rest = np.setdiff1d(rest, near, assume_unique=True)
            for k in near.tolist():
                yield k, root


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, budget: int = 4,
    group_rows: int = 1024, group_shingles: int = 4_000_000,
) -> DataFrame:
    """One row per row of ``docs``: identifier and ``component_id``, the least identifier that links reach.

    Two texts are linked if their fingerprints of shingles differ in at most ``budget`` bits, or if their
    shingle sets have a Jaccard similarity of ``least`` or more. Null, empty and
    wordless texts are equal. Null identifiers never are the least one, unless a component has no other: then
    it is null. Repeated rows stay; an empty table gives no rows. Only the two named columns are read."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), text_of(text_col).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("shingles", dict)
        for batch in batches:
            found, bits, sizes, keys = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                hashes = shingle_hashes(text, words)
                found.append(xxhash.xxh64_intdigest(normal(text)))
                bits.append(majority(hashes))
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                keys.append(np.array(band_keys(hashes) if len(hashes) else [], dtype=np.uint64).view(np.int64))
            signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (found, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *signed, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "print", "fp", "size", "keys"])

    known = written(spark, rows.mapInArrow(prints, f"id {kind}, print bigint, fp bigint, size bigint, keys array<bigint>"), "shingle_prints")
    nodes = written(spark, known.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")), "texts")
    firsts = nodes.groupBy("fp").agg(F.min("print").alias("first"))
    same = nodes.join(firsts, "fp").filter("print <> first").select(F.col("print").alias("a"), F.col("first").alias("b"))
    near = links(firsts.select("fp"), budget)
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    close = same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    banded = nodes.select("print", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("print").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = components(banded.join(shared, "key").filter("print <> first").select(F.col("print").alias("a"), F.col("first").alias("b")))
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(group_rows)), F.ceil(F.sum("size") / F.lit(group_shingles))).cast("int")
    sized = groups.join(nodes.select(F.col("print").alias("node"), "size"), "node")
    large = sized.groupBy("root").agg(chunks.alias("chunks")).filter("chunks > 1")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("shingles", dict)
        for batch in batches:
            joined = [normal(t) for t in batch.column(0).to_pylist()]
            signed = np.array([xxhash.xxh64_intdigest(j) for j in joined], dtype=np.uint64).view(np.int64)
            hashes = [shingle_set(j, words).tobytes() if j else b"" for j in joined]
            yield pa.RecordBatch.from_arrays([pa.array(signed), pa.array(hashes, pa.binary())], names=["print", "hashes"])

    # One row of each text in a group, found by its least identifier's row or, where it has none, by any.
    chosen = known.join(groups.select(F.col("node").alias("print"), "root"), "print").select("id", "print", "root")
    texts = rows.join(chosen.select("id").filter("id is not null").distinct(), "id", "left_semi")
    texts = texts.unionByName(rows.filter("id is null")).select("text")
    hashed = texts.mapInArrow(sets, "print bigint, hashes binary").join(groups.withColumnRenamed("node", "print"), "print")
    once = hashed.groupBy("print", "root").agg(F.first("hashes").alias("hashes"))
    dealt = (
        once.join(large, "root", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("root", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "print", "hashes")
        .repartition("root", "left", "right")
        .sortWithinPartitions("root", "left", "right", "print")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("shingles", dict)
        at, members, held = None, [], []

        def out() -> pa.RecordBatch:
            pairs = [(members[k], members[r]) for k, r in linked(held, least)] if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            root, left, right, name = (batch.column(k).to_pylist() for k in range(4))
            for k, value in enumerate(batch.column(4)):
                if at != (root[k], left[k], right[k]):
                    if len(held) > 1:
                        yield out()
                    at, members, held = (root[k], left[k], right[k]), [], []
                members.append(name[k])
                held.append(np.frombuffer(value.as_py(), dtype=np.uint64))
        if len(held) > 1:
            yield out()

    tree = components(close.unionByName(dealt.mapInArrow(compare, "a bigint, b bigint")))
    rooted = nodes.join(tree, nodes["print"] == tree["node"], "left").select("print", "n", "least", F.coalesce("root", "print").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(spark, rooted.join(smallest, "root").select("print", "n", "component_id"), "known")
    out = join_hot(known.select("id", "print"), found, ["print"], "n", known.count(), F.col("id"))
    return out.select(F.col("id").alias(id_col), "component_id")
