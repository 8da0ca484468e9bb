"""Language-model scores: prediction by partial matching over bytes, beside a word unigram base.

The model is a byte-context trie of order 5 with every context of the training texts, so it grows with
them. Tasks count strings of six bytes, a context of five and its symbol; Spark adds them up. A symbol's
probability is its share in the longest known context; an unseen symbol escapes (method C: as often as
the context has distinct symbols) to the next shorter one. Symbols already seen above are excluded there, from its
counts and from its escape alike; below order 0 all symbols are alike. A symbol seen after a context is seen
after each shorter one, so what is excluded depends on the last context alone, and for a fixed model these are numbers
per context and symbol. Contexts of up to two bytes (at most 65,793) are broadcast; the strings of six are dealt by the
last three bytes of their context, so all that a longer context needs is in one group, and each
string's number is computed once. A text's code length is a sum over its strings: the numbers of the
commonest, at most HOT_GRAMS, are broadcast, all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptable.llm.common import least_count, named, ship, text_of, worker_keeps, written

START, END = 0xFE, 0xFF  # bytes that no UTF-8 text holds: before a text, and its end
ORDER = 5
SYMBOLS = 255  # all bytes but START
HOT_WORDS = 1 << 18  # most words in the broadcast dictionary; rarer words are joined
HOT_GRAMS = 1 << 22  # most six-byte strings in the broadcast model; rarer ones are joined
_PIECE = 1 << 22
_CHUNK = 1 << 20  # bytes of texts that are looked up together


def padded(text: bytes) -> np.ndarray:
    return np.frombuffer(bytes([START] * ORDER) + text + bytes([END]), dtype=np.uint8)


def _arrays(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = frame.orderBy("code").toArrow()
    return found.column("code").to_numpy(), found.column("n").to_numpy().astype(np.float64)


def chunks(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(six-byte strings, the text of each, first place of each text's piece): padded texts, some at a time.

    Each symbol has its string, with the five before it; long texts go piece by piece."""
    held, owners, size = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.concatenate(held)
        wide, a, n = raw.astype(np.int64), ORDER, len(raw)
        code = wide[: n - a].copy()
        for k in range(1, a + 1):
            code <<= 8
            code |= wide[k : n - a + k]
        lengths = np.array([len(p) for p in held])
        inside = np.ones(n, dtype=bool)
        inside[(np.cumsum(lengths) - lengths)[:, None] + np.arange(a)] = False
        symbols = lengths - a
        return code[inside[a:]], np.array(owners), np.cumsum(symbols) - symbols

    for i, text in enumerate(texts):
        raw = padded(text)
        for at in range(0, len(raw) - ORDER, _PIECE):
            held.append(raw[at : at + ORDER + _PIECE])
            owners.append(i)
            size += len(held[-1])
            if size > _CHUNK:
                yield out()
                held, owners, size = [], [], 0
    if held:
        yield out()


def count_strings(rows: DataFrame) -> DataFrame:
    """(code, n, m): the six-byte strings of ``text``, their number where ``held`` is false, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        waiting, size = [], 0

        def merge() -> None:
            nonlocal codes, counts, waiting, size
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            codes, waiting, size = both, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

        for batch in batches:
            held = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for code, owner, first in chunks(t.as_py().encode() for t in batch.column(1)):
                waiting.append(code << 1 | np.repeat(held[owner], np.diff(np.append(first, len(code)))))
                size += len(code)
                if size > 3_000_000:
                    merge()
                    if len(codes) > 4_000_000:  # bounded memory: the sums go on in Spark
                        yield out()
                        codes, counts = codes[:0], counts[:0]
        if waiting:
            merge()
        if len(codes):
            yield out()

    found = rows.select("held", "text").mapInArrow(run, "code bigint, n bigint")
    learned = F.when(F.col("code").bitwiseAND(F.lit(1)) == 0, F.col("n")).otherwise(0)
    return found.groupBy(F.shiftright("code", 1).alias("code")).agg(F.sum(learned).alias("n"), F.sum("n").alias("m"))


def blend(n: np.ndarray, q: np.ndarray, total: np.ndarray, kinds: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Probabilities of symbols in a context of which ``total`` counts of ``kinds`` symbols are not excluded.

    ``n`` are the symbols' counts, ``q`` their probabilities after an escape; nothing escapes where all symbols
    are among the context's ``every`` kinds, and all does where no count is left."""
    escape = np.where(total > 0, np.where(every < SYMBOLS, kinds / np.maximum(total + kinds, 1), 0.0), 1.0)
    return np.where(n > 0, (1 - escape) * n / np.maximum(total, 1), escape * q)


class ShortContexts:
    """All contexts of up to two bytes, from (code, count) of two bytes and a symbol.

    Of each context of two bytes the counts, and after an escape from it the probabilities, which for an
    unmet one are those of its last byte."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        root, one = np.zeros((1, 256)), np.zeros((256, 256))
        np.add.at(root[0], code & 255, n)
        np.add.at(one, ((code >> 8) & 255, code & 255), n)
        codes2, at = np.unique(code >> 8, return_inverse=True)
        two = np.zeros((len(codes2), 256))
        np.add.at(two, (at, code & 255), n)
        alike = np.full((1, 256), 1 / max(1, SYMBOLS - np.count_nonzero(root)))
        alike[0, START] = 0
        first = self._escaped(one, root, alike)
        of = codes2 & 255
        own = blend(one, first, *self._sizes(one))
        self.after = np.concatenate([own, self._escaped(two, one[of], first[of])])
        self.row = np.arange(1 << 16) & 255
        self.row[codes2] = 256 + np.arange(len(codes2))
        total, kinds, _ = self._sizes(two)
        self.total, self.kinds = (np.concatenate([np.zeros(256), x[:, 0]]) for x in (total, kinds))
        self.code, self.n = code, n  # ascending

    @staticmethod
    def _sizes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds = np.count_nonzero(counts, axis=1)[:, None].astype(np.float64)
        return counts.sum(axis=1, keepdims=True), kinds, kinds

    @classmethod
    def _escaped(cls, counts: np.ndarray, shorter: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Probabilities after an escape, from the counts and such probabilities of each one's shorter context."""
        total, kinds, every = cls._sizes(shorter)
        _, seen, _ = cls._sizes(counts)
        return blend(shorter, q, total - (shorter * (counts > 0)).sum(axis=1, keepdims=True), kinds - seen, every)

    def at(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Count, probability after an escape, and the context's total and kinds, of two bytes and a symbol each."""
        row = self.row[code >> 8]
        place = np.searchsorted(self.code, code)
        n = np.zeros(len(code))
        met = place < len(self.code)
        met[met] = self.code[place[met]] == code[met]
        n[met] = self.n[place[met]]
        return n, self.after[row, code & 255], self.total[row], self.kinds[row]


def longer_contexts(code: np.ndarray, n: np.ndarray, short: ShortContexts) -> np.ndarray:
    """The probability of each six-byte string's symbol after its context.

    ``code`` holds all strings whose contexts end with the same three bytes, for some such endings; ``n`` is 0
    for a string that only scored texts have."""
    shorter = np.unique(code & 0xFFFFFFFF)
    count, q, total, kinds = short.at(shorter & 0xFFFFFF)
    for length in range(3, ORDER + 1):
        keys, at = np.unique(code & ((1 << 8 * (length + 1)) - 1), return_inverse=True)
        up = np.searchsorted(shorter, keys & ((1 << 8 * length) - 1)) if length > 3 else np.arange(len(keys))
        counts = np.bincount(at, weights=n, minlength=len(keys))
        context = np.unique(keys >> 8, return_inverse=True)[1]
        seen = counts > 0
        own, own_kinds = np.bincount(context, weights=counts)[context], np.bincount(context, weights=seen)[context]
        excluded = np.bincount(context, weights=count[up] * seen)[context]
        q = blend(count[up], q[up], total[up] - excluded, kinds[up] - own_kinds, kinds[up])
        count, total, kinds, shorter = counts, own, own_kinds, keys
    return blend(count, q, total, kinds, kinds)[np.searchsorted(shorter, code)]


def string_scores(counted: DataFrame) -> DataFrame:
    """(code, m, v): log10 of the probability of each six-byte string's symbol after its context."""
    spark = counted.sparkSession
    learned = counted.filter("n > 0")
    three = _arrays(learned.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFFFF)).alias("code")).agg(F.sum("n").alias("n")))
    shared = spark.sparkContext.broadcast(ShortContexts(*three))
    ending = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFFFF))
    dealt = counted.select(ending.alias("ending"), "code", "n", "m").repartition("ending").sortWithinPartitions("ending")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Whole endings, about 500,000 rows at a time."""
        waiting, rows = [], 0
        for batch in batches:
            waiting.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            rows += batch.num_rows
            if rows < 500_000:
                continue
            whole = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            last = int(np.searchsorted(whole[0], whole[0][-1]))  # the last ending may go on
            if last:
                yield [c[:last] for c in whole]
            waiting = [[c[last:] for c in whole]]
            rows -= last
        if rows:
            yield [np.concatenate(c) for c in zip(*waiting, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("short contexts", dict)
        for _, code, n, m in groups(batches):
            v = np.log10(np.maximum(longer_contexts(code, n, shared.value), 1e-30))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(m), pa.array(v)], names=["code", "m", "v"])

    return dealt.mapInArrow(run, "code bigint, m bigint, v double")


class Scores:
    """The broadcast strings and their numbers; a hash table of them is made once in each worker."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.code, self.value = code, value.astype(np.float32)

    def __getstate__(self) -> dict:
        return {"code": self.code, "value": self.value}

    def _place(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ready(self) -> Scores:
        if not hasattr(self, "keys"):
            self.bits = max(4, (2 * len(self.code)).bit_length())
            self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
            self.numbers = np.zeros(1 << self.bits, dtype=np.float32)
            code, value, place = self.code, self.value, self._place(self.code)
            while len(code):
                free = self.keys[place] < 0
                self.keys[place[free]] = code[free]
                here = self.keys[place] == code
                self.numbers[place[here]] = value[here]
                code, value, place = code[~here], value[~here], (place[~here] + 1) & (len(self.keys) - 1)
        return self

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers, 0 where a string is not among these; and the places of those strings."""
        place = self._place(code)
        key = self.keys[place]
        out = np.where(key == code, self.numbers[place], np.float32(0))
        absent, open_ = [np.flatnonzero(key < 0)], np.flatnonzero((key != code) & (key >= 0))
        place = place[open_]
        while len(open_):
            place = (place + 1) & (len(self.keys) - 1)
            key = self.keys[place]
            met = key == code[open_]
            out[open_[met]] = self.numbers[place[met]]
            absent.append(open_[key < 0])
            on = ~met & (key >= 0)
            open_, place = open_[on], place[on]
        return out, np.concatenate(absent)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): ASCII-lower-cased words over all rows of ``text``, and each text's end as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                found.update(text.as_py().encode().lower().split())
                if len(found) > 1_000_000:
                    yield out()
                    found.clear()
            found[b""] += batch.num_rows
        if found:
            yield out()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lm_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: identifier, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from the rows where ``held_out`` is false. Tokens are words and one end for each text. The
    base is a sum over tokens of log10((c + 1) / (N + V + 1)); the score is the PPM model's log10
    probability of the text's bytes and end. The end's count, the commonest words and strings of six bytes, at most HOT_WORDS and
    HOT_GRAMS, are broadcast; all others are joined, so every count is exact. A null text is empty: one token, its end. Repeated rows
    stay; without training rows every token is unknown; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(named(id_col).alias("id"), held_out.alias("held"), text_of(text_col).alias("text"))
    train = rows.filter(~F.col("held")).select("text")
    words = written(spark, count_words(train), "words")
    sums = words.agg(F.sum("n"), F.count(F.lit(1))).head()
    n_all, kinds = sums[0] or 0, sums[1]
    ends = words.filter(F.col("word") == "").agg(F.sum("n")).head()[0]  # every text has one, so it is never joined
    cut = least_count(words, "n", HOT_WORDS)
    hot = words.filter(F.col("n") >= cut).toArrow() if cut is not None else None
    frequent = {} if hot is None else dict(zip(hot.column("word").cast(pa.binary()).to_pylist(), hot.column("n").to_pylist(), strict=True))
    strings = written(spark, string_scores(written(spark, count_strings(rows), "strings")), "string_scores")
    common = least_count(strings, "m", HOT_GRAMS)
    top = strings.filter(F.col("m") >= common if common is not None else F.lit(False)).select("code", F.col("v").cast("float")).toArrow()
    if ends:
        frequent[b""] = ends
    shared = spark.sparkContext.broadcast((frequent, Scores(top.column("code").to_numpy(), top.column("v").to_numpy())))
    below = float(n_all + kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("language model", dict)
        counts, model = shared.value
        model.ready()
        log = {w: float(np.log10((n + 1) / below)) for w, n in counts.items()}
        absent = float(np.log10(1 / below))
        end = log.get(b"", absent)
        schema = pa.schema([("id", kind), ("held", pa.bool_()), ("print", pa.int64()), ("word", pa.string()), ("times", pa.int64()),
                            ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("uses", pa.int64())])
        for batch in batches:
            ids, held, prints = (batch.column(k).to_pylist() for k in (0, 1, 2))
            cells = [[] for _ in range(10)]

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
                for c in cells:
                    c.clear()
                return out

            def put(*row: object) -> None:
                for c, x in zip(cells, row, strict=True):
                    c.append(x)

            raws, scores = [t.as_py().encode() for t in batch.column(3)], np.zeros(batch.num_rows)
            for code, owner, first in chunks(iter(raws)):
                values, absent = model.look_up(code)
                np.add.at(scores, owner, np.add.reduceat(values, first, dtype=np.float64))
                of = owner[np.searchsorted(first, absent, side="right") - 1]
                for i in np.unique(of).tolist():
                    for g, n in zip(*map(np.ndarray.tolist, np.unique(code[absent[of == i]], return_counts=True)), strict=True):
                        put(ids[i], held[i], prints[i], f" #{g}", 0, 0, 0, 0.0, 0.0, n)
                    if len(cells[0]) > 50_000:
                        yield flush()
            for i, raw in enumerate(raws):
                tokens = raw.lower().split()
                values = list(map(log.get, tokens))
                rare = Counter(t for t, v in zip(tokens, values, strict=True) if v is None) if None in values else {}
                base = sum(v for v in values if v is not None) + end
                known = len(tokens) - sum(rare.values()) + (b"" in log)
                row = (ids[i], held[i], prints[i])
                # A word never holds a space, so this row meets no count and is dealt by its text.
                put(*row, f" {prints[i]}", 0, len(tokens) + 1, known, base, scores[i], 0)
                for w, n in rare.items():
                    put(*row, w.decode(), n, 0, 0, 0.0, 0.0, 0)
                if len(cells[0]) > 50_000:
                    yield flush()
            if cells[0]:
                yield flush()

    simple = rows.schema["id"].dataType.simpleString()
    kind = pa.string() if simple == "string" else pa.int64()
    keyed = rows if simple == "string" else rows.withColumn("id", F.col("id").cast("bigint"))
    simple = "string" if simple == "string" else "bigint"
    out = f"id {simple}, held boolean, print bigint, word string, times bigint, tokens bigint, known bigint, base double, score double, uses bigint"
    scored = keyed.select("id", "held", F.xxhash64("text").alias("print"), "text").mapInArrow(run, out)
    rare = words.filter(F.col("n") < cut) if cut is not None else words
    others = strings.filter(F.col("m") < common) if common is not None else strings
    numbered = others.select(F.concat(F.lit(" #"), "code").alias("word"), F.lit(None).cast("bigint").alias("c"), "v")
    joined = rare.select("word", F.col("n").alias("c"), F.lit(None).cast("double").alias("v")).unionByName(numbered)
    met = scored.join(joined, "word", "left")
    log10 = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(below))
    summed = met.groupBy("id", "held", "print").agg(
        F.count(F.when(F.col("tokens") > 0, 1)).alias("copies"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.when(F.col("times") > 0, F.col("times") * log10).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(F.col("uses") > 0, F.col("uses") * F.col("v")).otherwise(0.0)).alias("score"),
    )
    # Equal rows were added up: each gets its part again.
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        F.expr("tokens div copies").alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )
