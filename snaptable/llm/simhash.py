"""SimHash near-duplicates: fingerprints, a binary-trie self-join under a Hamming budget, components.

Exact copies collapse to one fingerprint first. Two fingerprints that differ in at most
``budget`` of 64 bits agree on one of ``budget + 1`` blocks of bits, so the join runs once per
block, among the fingerprints with the same value there. Within such a bucket the sorted
fingerprints are a binary trie; pairs of trie nodes are walked down together, level by level, and
a pair is dropped as soon as its differing bits exceed the budget. In a bucket over ``bucket_rows`` the
remaining bits are cut into ``budget + 1`` blocks in turn, so each row goes on to that many smaller buckets.
Where that would not make less work, among fingerprints that are nearly all alike, and in what is still over
``bucket_rows``, the rows are dealt into chunks and every pair of chunks becomes a task of its own; no bucket is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptable.llm.common import counted, fresh, join_hot, named, ship, text_of, worker_keeps, written

BITS = 64


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; a shorter text is one shingle."""
    tokens = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=False)), dtype=np.uint64, count=len(stops))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text goes piece by piece
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(identifier, ``fp`` as a signed long) for every row; a null text counts as empty and has fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("fingerprints", dict)
        last, value = None, 0
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=np.uint64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text != last:
                    last, value = text, fingerprint(text, words, seed)
                out[i] = value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(named(id_col).alias("id"), text_of(text_col).alias("text"))
    return frame.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def masks(within: int, budget: int) -> list[int]:
    """The set bits of ``within`` cut into budget + 1 nearly equal blocks, from the lowest on."""
    bits = [k for k in range(BITS) if within >> k & 1]
    edges = [round(k * len(bits) / (budget + 1)) for k in range(budget + 2)]
    return [sum(1 << k for k in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def trie_pairs(values: np.ndarray, sides: np.ndarray, groups: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of linked fingerprints, in pieces.

    ``values`` are unsigned, ``groups`` ascending; within a group side 0 comes before side 1 and
    values ascend within a side. A group with one side is joined with itself, one with two sides
    across them. Equal ranges of the sorted values are the nodes of the trie."""
    ones: dict[int, np.ndarray] = {}

    def before(level: int) -> np.ndarray:
        if level not in ones:
            bit = ((values >> np.uint64(BITS - 1 - level)) & np.uint64(1)).astype(np.int64)
            ones[level] = np.concatenate([[0], np.cumsum(bit)])
        return ones[level]

    n = len(values)
    if n < 2:
        return
    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    low, high = edge, np.append(edge[1:], n)
    split = np.concatenate([[0], np.cumsum(sides == 0)])
    middle = low + split[high] - split[low]
    two = (middle > low) & (middle < high)
    one = ~two & (high - low > 1)
    first = np.concatenate([low[one], low[two]])
    first_end = np.concatenate([high[one], middle[two]])
    second = np.concatenate([low[one], middle[two]])
    second_end = np.concatenate([high[one], high[two]])
    stack = [(0, first, first_end, second, second_end, np.zeros(len(first), dtype=np.int8))]
    while stack:
        level, a, b, c, d, apart = stack.pop()
        if len(a) > 200_000:  # a bounded frontier: the rest waits on the stack
            half = len(a) // 2
            stack.append((level, a[:half], b[:half], c[:half], d[:half], apart[:half]))
            stack.append((level, a[half:], b[half:], c[half:], d[half:], apart[half:]))
            continue
        same = a == c
        small = np.where(same, b - a <= 2, (b - a) * (d - c) <= 2) if level < BITS else np.ones(len(a), dtype=bool)
        if small.any():
            yield from _leaves(values, a[small], b[small], c[small], d[small], same[small], budget)
            keep = ~small
            a, b, c, d, apart, same = a[keep], b[keep], c[keep], d[keep], apart[keep], same[keep]
        if not len(a):
            continue
        count = before(level)
        mid1, mid2 = b - (count[b] - count[a]), d - (count[d] - count[c])
        parts = [
            (a, mid1, c, mid2, apart, a == a),
            (mid1, b, mid2, d, apart, a == a),
            (a, mid1, mid2, d, apart + 1, a == a),
            (mid1, b, c, mid2, apart + 1, ~same),  # a node with itself has this pair once
        ]
        merged = [np.concatenate([p[k] for p in parts]) for k in range(6)]
        x, y, u, v, e, ok = merged
        ok = ok & (y > x) & (v > u) & (e <= budget) & ~((x == u) & (y - x < 2))
        if ok.any():
            stack.append((level + 1, x[ok], y[ok], u[ok], v[ok], e[ok].astype(np.int8)))


def _leaves(values, a, b, c, d, same, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Checks all pairs of small nodes; a larger node at the last level holds equal values only."""
    wide, deep = (b - a), (d - c)
    for at in range(0, len(a), 200_000):
        s = slice(at, at + 200_000)
        sizes = wide[s] * deep[s]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i = a[s][owner] + inner // deep[s][owner]
        j = c[s][owner] + inner % deep[s][owner]
        ok = ~same[s][owner] | (i < j)
        i, j = i[ok], j[ok]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        if near.any():
            yield i[near], j[near]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of each position that shares a component with a smaller one."""
    root = np.arange(n)

    def settle() -> None:
        while True:
            nxt = root[root]
            if (nxt == root).all():
                return
            root[:] = nxt

    for i, j in pairs:
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if len(i):
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                settle()
    settle()
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def links(distinct: DataFrame, budget: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` that connect all pairs within the budget.

    Within a task only a spanning forest of the links is returned, so a dense group of m
    fingerprints gives m - 1 rows there and not m * m. Among fingerprints that spread evenly each row is copied
    budget + 1 times, or the square of that where buckets are large; only in a dense group over ``bucket_rows`` the copies grow with it."""
    spark = distinct.sparkSession
    ship(spark)
    first = masks((1 << BITS) - 1, budget)
    every = [(signed(m), [signed(m | x) for x in masks(((1 << BITS) - 1) ^ m, budget)]) for m in first]
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m, _ in every])).alias("mask"))
    rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    chunks = F.ceil(F.col("n") / F.lit(bucket_rows)).cast("int")
    large = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows)
    large = counted(written(spark, large.withColumn("chunks", chunks), "large"))
    # Within large buckets: the buckets of the next blocks, and whether they make less work than pairs of chunks.
    nexts = F.coalesce(*[F.when(F.col("mask") == m, F.array(*[F.lit(x) for x in more])) for m, more in every])
    inner = rows.join(large.select("mask", "value"), ["mask", "value"], "left_semi").withColumn("mask2", F.explode(nexts))
    inner = inner.withColumn("value2", F.col("fp").bitwiseAND(F.col("mask2")))
    sizes = inner.groupBy("mask", "value", "mask2", "value2").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks2", chunks)
    work = sizes.groupBy("mask", "value").agg(F.sum(F.col("n") * F.col("chunks2")).alias("work"))
    split = large.join(work, ["mask", "value"]).filter(F.col("work") < F.col("n") * F.col("chunks")).select("mask", "value")
    split = counted(written(spark, split, "split"))
    over = counted(written(spark, sizes.filter("chunks2 > 1").join(split, ["mask", "value"], "left_semi").drop("n"), "over"))
    whole = rows.join(split, ["mask", "value"], "left_anti").join(large.drop("n"), ["mask", "value"], "left")
    whole = whole.select("fp", F.col("mask").alias("block"), "value", "chunks")
    parted = inner.join(split, ["mask", "value"], "left_semi").join(over, ["mask", "value", "mask2", "value2"], "left")
    parted = parted.select("fp", F.xxhash64("mask", "mask2").alias("block"), F.col("value2").alias("value"), F.col("chunks2").alias("chunks"))
    dealt = (
        whole.unionByName(parted)
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "fp", "block", "value",
            F.least("own", "other").alias("left"),
            F.greatest("own", "other").alias("right"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
        .repartition("block", "value", "left", "right")
        .sortWithinPartitions("block", "value", "left", "right", "side", "fp")
    )
    flip = np.uint64(1 << 63)  # signed order becomes unsigned order; distances stay

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Whole groups, about 200,000 rows at a time."""
        waiting: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            waiting.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)])
            rows += batch.num_rows
            if rows < 200_000:
                continue
            whole = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            new = np.zeros(rows, dtype=bool)
            for c in (1, 2, 3, 4):
                new[1:] |= whole[c][1:] != whole[c][:-1]
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if last:
                yield [c[:last] for c in whole]
            waiting, rows = [[c[last:] for c in whole]], rows - last
        if rows:
            yield [np.concatenate(c) for c in zip(*waiting, strict=True)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, block, value, left, right, side in pieces(batches):
            new = np.ones(len(fp), dtype=bool)
            new[1:] = False
            for c in (block, value, left, right):
                new[1:] |= c[1:] != c[:-1]
            unsigned = fp.view(np.uint64) ^ flip
            member, root = forest(len(fp), trie_pairs(unsigned, side, np.cumsum(new), budget))
            yield pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[root])], names=["a", "b"])

    return dealt.mapInArrow(join, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b); the root is one node of its component.

    Each round sends every node to its least neighbour (in hashed order), jumps once more,
    and contracts the edges; the tables are written each round, and their number is logarithmic."""
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = written(spark, both(edges.filter("a <> b")).filter("a < b").distinct(), "edges")
    found = None
    while not edges.isEmpty():
        rank = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("node"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("node"))
        least = both(edges).groupBy("a").agg(F.min(rank).alias("m"), F.first("a").alias("same"))
        step = least.select("a", F.least(F.col("m"), own)["node"].alias("to"))
        step = written(spark, step, "step")
        jumped = step.join(step.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.col("far").alias("to"))
        jumped = written(spark, jumped, "jump")
        if found is None:
            found = jumped.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            found = found.join(jumped.withColumnRenamed("a", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        found = written(spark, found, "found")
        moved = edges.join(jumped.select(F.col("a"), F.col("to").alias("x")), "a").join(
            jumped.select(F.col("a").alias("b"), F.col("to").alias("y")), "b"
        )
        pair = moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = written(spark, pair.distinct(), "edges")
    if found is None:
        return spark.createDataFrame([], "node bigint, root bigint")
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, budget: int = 4
) -> DataFrame:
    """One row per row of ``docs``: identifier, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the least identifier among all documents reachable by links, itself included.
    Null identifiers never are that least one, unless a component has no other: then it is null.
    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows stay.
    An empty table gives no rows. Only the two named columns are read."""
    spark = docs.sparkSession
    prints = written(spark, fingerprints(docs, id_col, text_col, words, seed).withColumnRenamed(id_col, "id"), "prints")
    nodes = written(spark, prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    tree = components(links(nodes.select("fp"), budget))
    rooted = nodes.join(tree, nodes["fp"] == tree["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(spark, rooted.join(smallest, "root").select("fp", "n", "component_id"), "known")
    return join_hot(prints, known, ["fp"], "n", prints.count(), F.col("id")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The document with the least identifier of each component of ``found``, with all its columns.

    Rows that repeat an identifier count as one document: one of them stays, the same in every run.
    A row without an identifier cannot be named as a copy of another and stays."""
    own = named(id_col)
    mark, times = fresh(docs.columns, "mark", "times")
    stays = found.filter(own == F.col("component_id")).groupBy(own.alias(mark)).agg(F.count(F.lit(1)).alias(times))
    once = docs.join(stays.filter(F.col(times) == 1), own == F.col(mark), "left_semi")
    # Few identifiers repeat; of a hot one each task sends one row on.
    again = docs.join(stays.filter(F.col(times) > 1), own == F.col(mark), "left_semi")
    whole = [named(c) for c in docs.columns]
    again = again.groupBy(own.alias(mark)).agg(F.min_by(F.struct(*whole), F.xxhash64(*whole)).alias(times))
    again = again.select(*[F.col(times).getField(c).alias(c) for c in docs.columns])
    return once.unionByName(again).unionByName(docs.filter(own.isNull()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, budget: int = 4) -> DataFrame:
    """The document with the least identifier of each group of near-duplicates, with all its columns.

    A link is a SimHash within ``budget`` bits, or a Jaccard similarity of ``least`` or more of the shingle
    sets, which 64 bits alone cannot tell: see ``shingles``. Nulls, empty texts, repeated rows and
    empty tables are as there and in ``keep_least``; other columns, whatever their names, are not looked at."""
    from snaptable.llm import shingles

    return keep_least(docs, shingles.near_duplicates(docs, id_col, text_col, words, least, budget), id_col)
