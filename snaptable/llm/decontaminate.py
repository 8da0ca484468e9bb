"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers verification.

A copy of a test item with at most k errors holds at least one of the item's k + 1 pieces
unchanged. All pieces go into one Aho-Corasick automaton that runs over every whole text; each hit
names a window where the item may stand, and Myers' bit-parallel edit distance (the pattern may
begin and end anywhere in the window) decides. Test items lie as files in the shared folder, in blocks of bounded
size; workers read them there. The documents are read once: a task takes some texts at a time through all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptable.llm.common import named, shared_path, ship, text_of, worker_keeps

ERROR_RATE = 0.08  # errors allowed for each character of an item
LEAST_CHARS = 15  # shorter items, once normalised, could stand in any text
BLOCK_CHARS = 2_000_000  # of test items in one automaton, about
KEPT_BLOCKS = 4  # automata that a worker keeps; more are made again for every GATHERED characters of texts
GATHERED = 16_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def error_budget(item: str, rate: float = ERROR_RATE) -> int:
    """Errors allowed for a normalised item, rounded down; 0 for the shortest, which must then occur exactly."""
    return int(rate * len(item))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(place, piece): the item cut into errors + 1 nearly equal pieces."""
    edges = [round(i * len(item) / (errors + 1)) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Myers:
    """Edit distance of one pattern to the best substring of a text, a bit for each pattern character."""

    def __init__(self, pattern: str):
        self.m, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(least distance, the first end where it is reached)"""
        m, full, top = self.m, (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score = full, 0, self.m
        least, at = m, 0
        get = self.masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            x = eq | minus
            diagonal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(diagonal | plus) & full
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full  # a substring may begin anywhere: no bit comes in below
            down = down << 1 & full
            plus = down | ~(x | up) & full
            minus = up & x
            if score < least:
                least, at = score, j
        return least, at


class Finder:
    """Finds a block of items (identifier, text) in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, normal(t)) for i, t in items]
        self.errors = [error_budget(t, rate) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            if t:
                for place, piece in pieces(t, self.errors[n]):
                    where.setdefault(piece, []).append((n, place))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.empty = not where
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, errors, start, end) for each item within its budget, in the normalised text."""
        if self.empty:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, place in places:
                k = self.errors[n]
                start = end + 1 - size - place
                low, high = max(0, start - k), min(len(text), start + len(self.items[n][1]) + k)
                runs = windows.setdefault(n, [])
                for run in reversed(runs):
                    if low <= run[1] and high >= run[0]:
                        run[0], run[1] = min(run[0], low), max(run[1], high)
                        break
                    if run[1] < low - 2 * len(self.items[n][1]):
                        runs.append([low, high])
                        break
                else:
                    runs.append([low, high])
        out = []
        for n, runs in sorted(windows.items()):
            best = None
            for low, high in runs:
                found = self._check(n, text[low:high])
                if found and (best is None or found[0] < best[1]):
                    best = (n, found[0], low + found[1], low + found[2])
                    if not found[0]:
                        break
            if best:
                out.append(best)
        return out

    def _check(self, n: int, window: str) -> tuple[int, int, int] | None:
        item = self.items[n][1]
        exact = window.find(item)
        if exact >= 0:
            return 0, exact, exact + len(item)
        if not self.errors[n]:
            return None
        if n not in self.forward:
            self.forward[n], self.backward[n] = Myers(item), Myers(item[::-1])
        errors, end = self.forward[n].best(window)
        if errors > self.errors[n]:
            return None
        _, size = self.backward[n].best(window[:end][::-1])
        return errors, end - size, end


@dataclass
class Items:
    """Test items in the shared folder, in blocks."""

    path: str
    blocks: int
    rate: float

    def finder(self, block: int) -> Finder:
        kept = worker_keeps(f"items {self.path}", dict)
        if block not in kept:
            while len(kept) >= KEPT_BLOCKS:
                kept.pop(next(iter(kept)))
            store, root = fs.FileSystem.from_uri(f"{self.path}/block={block}")
            files = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            rows = []
            for name in sorted(f.path for f in files if f.path.endswith(".parquet")):
                with store.open_input_file(name) as file:
                    found = pq.read_table(file, columns=["item", "text"])
                rows += zip(found.column("item").to_pylist(), found.column("text").to_pylist(), strict=True)
            # In one order, however the files were written, so that hits come in one order.
            kept[block] = Finder(sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1])), self.rate)
        return kept[block]


def shared_items(bench: DataFrame, item_col: str, text_col: str, kind: str, rate: float, least_chars: int) -> Items:
    """Writes the items of ``least_chars`` characters or more, dealt to blocks of about BLOCK_CHARS by their texts.

    Nothing is collected. Repeated items meet in one block."""
    spark = bench.sparkSession
    rows = bench.select(named(item_col).cast(kind).alias("item"), text_of(text_col).alias("text"))
    rows = rows.filter(F.length(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))) >= least_chars)
    total = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    path = shared_path(spark, "items")
    if blocks:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
        dealt.write.partitionBy("block").parquet(path)
    return Items(path, blocks, rate)


def gathered(batches: Iterator[pa.RecordBatch], column: int, blocks: int) -> Iterator[list[tuple[pa.RecordBatch, list[str]]]]:
    """Batches with their texts: one at a time, or several together where there are more blocks than a worker keeps."""
    held, size = [], 0
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(column)]
        held.append((batch, texts))
        size += sum(map(len, texts))
        if blocks <= KEPT_BLOCKS or size >= GATHERED:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """(identifier, item, ``errors``, ``start``, ``end``) for every document row and item found in it.

    Case and runs of white space don't count; places are those of the normalised text, of the
    best occurrence (the first among equals). Null and empty texts hold nothing; null and blank items, and those
    of fewer than ``least_chars`` characters, are held by nothing; repeated rows and items each give rows; without
    documents or items there are no rows. Other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = "string" if bench.schema[item_col].dataType.typeName() == "string" else "bigint"
    items = shared_items(bench, item_col, item_text_col, item_kind, rate, least_chars)
    schema = f"id {kind}, item {item_kind}, errors bigint, start bigint, `end` bigint"
    item_type = pa.string() if item_kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches, 1, items.blocks):
            for block in range(items.blocks):
                finder = items.finder(block)
                for batch, texts in group:
                    at, rows = [], []
                    for i, t in enumerate(texts):
                        hits = finder.find(t)
                        at += [i] * len(hits)
                        rows += hits
                    if rows:
                        columns = [pa.array([finder.items[n][0] for n, *_ in rows], item_type), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["id", "item", "errors", "start", "end"])

    frame = docs.select(named(id_col).alias("id"), text_of(text_col).alias("text"))
    return frame.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_text_col: str = "text", rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are, whatever their names.

    Null and empty texts hold nothing; items are as in ``find_leaks``; repeated rows go or stay together; an empty table gives no rows."""
    ship(docs.sparkSession)
    alone = bench.select(F.lit(0).alias("item"), named(item_text_col).alias("text"))
    items = shared_items(alone, "item", "text", "bigint", rate, least_chars)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches, at, items.blocks):
            stays = [[True] * len(texts) for _, texts in group]
            for block in range(items.blocks):
                finder = items.finder(block)
                for kept, (_, texts) in zip(stays, group, strict=True):
                    for i, t in enumerate(texts):
                        kept[i] = kept[i] and not finder.find(t)
            for kept, (batch, _) in zip(stays, group, strict=True):
                yield batch.filter(pa.array(kept, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
