"""Toxicity: a learned lexicon as a trie, intersected with Levenshtein automata, read in context.

The lexicon is learned from a bounded sample of labelled texts: words and stems far commoner in toxic
ones, each of which explains toxic texts that those before it did not. All words within a term's edit budget are
found by walking the trie and the word's Levenshtein automaton together; the sets of (trie node,
edits) reached are the states of a lazily built deterministic automaton, so most words die after a
few characters. Each match is weighed by a window around it, quotation and report against address: a word of the
window counts by how much commoner it is around matches of toxic texts than around those of others, whatever the
language, and where the labels say little by a prior. A logistic regression turns a text's matches into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptable.llm.common import named, ship, text_of, worker_keeps, written

TOXIC_SAMPLE, CLEAN_SAMPLE = 4000, 8000  # most labelled texts that the model is fitted on
WINDOW = 6  # tokens of context on either side
LEAST_SEEN = 20  # matches that a word of the window must stand near to be learned
LEAST_Z = 2.5  # what a window word's log ratio must be from its prior in standard errors, for many are looked at
PRIOR_VARIANCE = 1.0  # of a window word's log factor
SEEN_WORDS = 500_000
MISSPELLED = 0.25  # what a made-up misspelled text counts in the regression
_STATES = 50_000

#: Characters that stand for letters in disguised spellings.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
QUOTED = '"'  # the name of a match's being in quotes among the words of its window
REPORT = "said says saying called calls quote quoted quotes wrote writes written word term phrase meaning means".split()
ADDRESS = "you your youre u ur are such".split()
#: Log factors of window words before any label is seen.
PRIOR = {QUOTED: log(0.4)} | dict.fromkeys(REPORT, log(0.6)) | dict.fromkeys(ADDRESS, log(1.3))
_QUOTES = "\"'“”‘’«»„`"
_EDGE = ".,;:!?()[]{}<>|-–—…" + _QUOTES


def budget(term: str) -> int:
    """Edits allowed: none below 5 letters, one below 8, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def stem_budget(stem: str) -> int:
    """Edits allowed in a stem (without its ``*``), which more words come near to: those of a word one letter shorter."""
    return budget(stem[1:])


class LexiconAutomaton:
    """All terms within their edit budget of a word, by intersection of trie and automaton.

    A term that ends in ``*`` is a stem: it matches every word that begins with something within its own budget."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        self.child: list[dict[str, int]] = [{}]
        self.term = [-1]
        self.stem = [-1]
        self.room = [0]  # the largest budget below a node
        for n, t in enumerate(self.terms):
            at, stem = 0, t.endswith("*")
            room = stem_budget(t[:-1]) if stem else budget(t)
            for c in t.rstrip("*"):
                self.room[at] = max(self.room[at], room)
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                    self.stem.append(-1)
                    self.room.append(0)
                at = self.child[at][c]
            self.room[at] = max(self.room[at], room)
            if stem:
                self.stem[at] = n
            else:
                self.term[at] = n
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.begins: list[tuple[int, int] | None] = []  # (edits, stem) that a state has just completed
        self.first = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of a set of (node, edits); -1 for the empty set. Letters a word lacks are skipped here."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            for below in self.child[node].values():
                if edits + 1 <= self.room[below] and edits + 1 < reached.get(below, 99):
                    reached[below] = edits + 1
                    todo.append((below, edits + 1))
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= budget(self.terms[self.term[n]])]
            self.accepts.append(min(ends) if ends else None)
            begun = [(e, self.stem[n]) for n, e in key if self.stem[n] >= 0 and e <= stem_budget(self.terms[self.stem[n]][:-1])]
            self.begins.append(min(begun) if begun else None)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.room[node] and edits < out.get(node, 99):
                out[node] = edits

        like = LOOKALIKES.get(c)
        for node, edits in self.states[state]:
            reach(node, edits + 1)  # a letter too many
            for letter, below in self.child[node].items():
                reach(below, edits + (letter != c and letter != like))
        found = self.moves[state][c] = self._state(out)
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term; among equals a whole word, then the first in order; None if there is none."""
        if len(self.states) > _STATES:
            self._reset()
        at, stem = self.first, self.begins[self.first]
        for c in word:
            nxt = self.moves[at].get(c)
            at = self._move(at, c) if nxt is None else nxt
            if at < 0:
                break
            begun = self.begins[at]
            if begun and (stem is None or begun < stem):
                stem = begun
        found = self.accepts[at] if at >= 0 else None
        if stem and (found is None or stem[0] < found[0]):
            found = stem
        return (self.terms[found[1]], found[0]) if found else None


def bare(token: str) -> str:
    return token.strip(_EDGE).lower()


class Scorer:
    """Finds and weighs matches; remembers which tokens match nothing, up to SEEN_WORDS of them."""

    def __init__(self, terms: list[str], usual: set[str], weights: np.ndarray | None, context: dict[str, float] | None = None):
        self.automaton = LexiconAutomaton(terms)
        self.usual, self.weights = usual, weights  # usual: words near a term that are ordinary words
        self.context = PRIOR if context is None else context
        self.clear: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def _look(self, tokens: list[str]) -> bool:
        new = set(tokens).difference(self.clear)
        found = False
        for t in new:
            if t in self.hits:
                found = True
                continue
            word = bare(t)
            hit = self.automaton.match(word) if word else None
            if hit and (hit[1] == 0 or word not in self.usual):
                self.hits[t] = hit
                found = True
            else:
                self.clear.add(t)
        return found

    def matches(self, text: str) -> list[tuple[int, str, int, float]]:
        """(token number, term, edits, weight) of every match; weight below 1 for quotation, above for address."""
        tokens = text.split()
        if len(self.clear) > SEEN_WORDS:
            self.clear.clear()
        if len(self.hits) > SEEN_WORDS:
            self.hits.clear()
        if not self._look(tokens):
            return []
        out = []
        for i, t in enumerate(tokens):
            if hit := self.hits.get(t):
                out.append((i, *hit, self._weight(tokens, i)))
        return out

    @staticmethod
    def window(tokens: list[str], i: int) -> set[str]:
        """The words around a token, and QUOTED if quotes open before or at it and close at or after it."""
        before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
        opened = any(t[0] in _QUOTES for t in [*before, tokens[i]])
        closed = any(t.rstrip(".,;:!?)")[-1:] in _QUOTES and t.rstrip(".,;:!?)") for t in [tokens[i], *after])
        near = {bare(t) for t in before} | {bare(t) for t in after}
        return near | {QUOTED} if opened and closed else near

    def _weight(self, tokens: list[str], i: int) -> float:
        return exp(min(1.0, max(-2.0, sum(self.context.get(w, 0.0) for w in self.window(tokens, i)))))

    @staticmethod
    def measure(matches: list[tuple[int, str, int, float]]) -> list[float]:
        """Of a text's matches: any exact one, their weight; any near a word, their weight; any near a stem, their
        weight; the mean logarithm of weights; and 1."""
        sums = [0.0, 0.0, 0.0]
        for _, term, edits, weight in matches:
            sums[0 if not edits else 2 if term.endswith("*") else 1] += weight / (1 + edits)
        lean = sum(log(w) for *_, w in matches) / max(1, len(matches))
        return [x for s in sums for x in (min(s, 1.0), float(np.log1p(s)))] + [lean, 1.0]

    def score(self, text: str) -> tuple[float, int]:
        """(score, number of matches)"""
        found = self.matches(text)
        if self.weights is None:
            return 0.0, len(found)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.measure(found), self.weights), -30, 30)))), len(found)


def misspelled(matches: list[tuple[int, str, int, float]]) -> list[tuple[int, str, int, float]]:
    """A text's matches as if the exact ones were one edit away."""
    return [(i, term, max(edits, 1), weight) for i, term, edits, weight in matches]


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a penalised logistic regression, by Newton steps; the last column is the constant."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    keep[-1] = 1e-3
    c = np.ones(len(y)) if counts is None else counts
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (p - y)) + keep * w
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, toxic) of at most TOXIC_SAMPLE + CLEAN_SAMPLE labelled identifiers, the first in hashed order, written down.

    Of several rows of an identifier one text counts, and the higher label; null identifiers and labels count for nothing."""
    spark = docs.sparkSession
    ids = labels.filter(learn).select(named(id_col).alias("id"), named(label_col).alias("toxic")).filter("id is not null and toxic is not null")
    ids = ids.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(5)))
    some = None
    for toxic, most in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        part = ids.filter(F.col("toxic") == toxic).orderBy("h", "id").limit(most)
        some = part if some is None else some.unionByName(part)
    some = written(spark, some.select("id", "toxic"), "sample-ids")
    rows = docs.select(named(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(some), "id")
    # One text for each identifier, and each text once, so repeated rows and copies don't widen the sample.
    rows = rows.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return written(spark, rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("id", "text", "toxic"), "id").alias("r")).select("r.*"), "sample")


def forms(text: str) -> set[str]:
    """A text's words and, with a ``*``, their beginnings of four letters or more; longer than 40 letters a word counts whole only."""
    words = {w for w in map(bare, text.split()) if w}
    return words | {f"{w[:k]}*" for w in words if len(w) < 40 for k in range(4, len(w))}


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Words and stems, each chosen for the toxic sample texts that it newly explains less four times its clean texts.

    Candidates occur in a hundredth of the toxic sample texts at least, so the sample bounds their number. Ties go to whole
    words, then to longer forms; a sample without toxic texts has no terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(forms(text))
        for at in (0, 1):
            n = len(found[at])
            columns = [pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64())]
            columns[at] = pa.array(found[at].values(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found[at].keys(), pa.string()), *columns], names=["form", "clean", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return []
    words = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "form string, clean bigint, toxic bigint")
    words = words.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    enough = max(2, n_toxic // 100)
    good = words.filter((F.col("toxic") >= enough) & (F.col("toxic") >= 4 * F.col("clean"))).filter(odds >= 8)
    gain = F.col("toxic") - 4 * F.col("clean")
    # Among equals a whole word goes before a stem, and a longer stem before a shorter one.
    top = good.orderBy(F.desc(gain), F.col("form").endswith("*"), F.desc(F.length("form")), "form")
    rows = top.collect()
    candidates, cost = [r["form"] for r in rows], [4 * r["clean"] for r in rows]
    place = {w: i for i, w in enumerate(candidates)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [sorted({place[w] for w in forms(t) if w in place}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.list_(pa.int32()))], names=["has"])

    rows = [set(r["has"]) for r in sample.filter("toxic = 1").select("text").mapInArrow(held, "has array<int>").collect()]
    chosen = []
    while rows:
        counts = Counter(i for r in rows for i in r)
        if not counts:
            break
        best, n = max(counts.items(), key=lambda x: (x[1] - cost[x[0]], -x[0]))
        if n - cost[best] < 2:  # what is left are a few texts that share no term
            break
        chosen.append(candidates[best])
        rows = [r for r in rows if best not in r]
    return chosen


def learn_context(sample: DataFrame, terms: list[str], usual: set[str]) -> dict[str, float]:
    """Log factors of window words, from the windows of all matches in labelled texts (``text``, ``y``).

    A word's is the posterior mean of a normal whose prior is PRIOR with PRIOR_VARIANCE, and whose observation is
    the log ratio of the shares of windows with the word in toxic and other texts. Words in fewer than LEAST_SEEN windows,
    or less than LEAST_Z standard errors from their prior, keep it; without matches in either kind of text all do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, found = Scorer(terms, usual, None), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = text.split()
                for i, *_ in scorer.matches(text):
                    found[y].update(scorer.window(tokens, i) | {""})  # the empty word counts the matches
        for y in (0, 1):
            columns = [pa.array(list(found[y]), pa.string()), pa.array([y] * len(found[y]), pa.int32()), pa.array(found[y].values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "y", "n"])

    sums = sample.select("text", "y").mapInArrow(count, "word string, y int, n bigint").groupBy("word")
    sums = sums.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("other"))
    rows = {r["word"]: (r["toxic"], r["other"]) for r in sums.filter((F.col("toxic") + F.col("other") >= LEAST_SEEN) | (F.col("word") == "")).collect()}
    all_toxic, all_other = rows.pop("", (0, 0))
    out = dict(PRIOR)
    if not all_toxic or not all_other:
        return out
    for word, (a, b) in rows.items():
        seen = log((a + 1) / (all_toxic + 2) / ((b + 1) / (all_other + 2)))
        before, spread = PRIOR.get(word, 0.0), 1 / (a + 1) + 1 / (b + 1)
        if abs(seen - before) >= LEAST_Z * spread**0.5:
            out[word] = (seen / spread + before / PRIOR_VARIANCE) / (1 / spread + 1 / PRIOR_VARIANCE)
    return {w: round(x, 6) for w, x in out.items() if abs(x) >= 0.05}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(terms, ordinary words near a term, weights, factors of window words) from labelled rows where ``learn`` holds.

    Bounded as the module says. Null texts are empty; labels of absent documents, null labels and identifiers count for nothing;
    repeated rows count once. Without a toxic text, or without rows, there are no terms and the weights are None."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, learn, id_col, text_col, label_col)
    terms = learn_lexicon(sample)
    if not terms:
        return [], set(), None, PRIOR

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found = LexiconAutomaton(terms), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in {bare(t) for t in text.split()}:
                    if w and (hit := find.match(w)) and hit[1]:
                        found.add(w)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    half = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(9)), F.lit(2))  # words from one half, weights from the other
    clean = sample.filter((F.col("toxic") == 0) & (half == 0)).select("text")
    usual = {r["word"] for r in clean.mapInArrow(near, "word string").distinct().collect()}
    labelled = sample.select("text", F.col("toxic").cast("int").alias("y"), half.alias("half"))
    context = learn_context(labelled.filter((F.col("y") == 1) | (F.col("half") == 0)), terms, usual)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, usual, None, context)
        for batch in batches:
            found = [scorer.matches(t) for t in batch.column(0).to_pylist()]
            x = [scorer.measure(m) for m in found]
            also = [scorer.measure(misspelled(m)) if any(not e for _, _, e, _ in m) else None for m in found]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(also, kind), batch.column(1)], names=["x", "also", "y"])

    rest = labelled.filter((F.col("y") == 1) | (F.col("half") == 1)).select("text", "y")
    rows = rest.mapInArrow(measure, "x array<double>, also array<double>, y int").collect()
    # Labelled texts seldom show each misspelling: the toxic ones count once more, a little, as if misspelled.
    also = [r["also"] for r in rows if r["y"] and r["also"]]
    x = np.array([r["x"] for r in rows] + also)
    y = np.array([float(r["y"]) for r in rows] + [1.0] * len(also))
    return terms, usual, logistic(x, y, np.array([1.0] * len(rows) + [MISSPELLED] * len(also))), context


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: identifier, ``score`` (0 to 1), ``predicted``, ``n_matches``.

    A null text is empty and has no match, like any other text without one. A model that found nothing to learn
    gives 0.0. Repeated rows stay; an empty table gives no rows; other columns are not read."""
    ship(docs.sparkSession)
    terms, usual, weights, context = model
    name = f"{hash((tuple(terms), tuple(sorted(usual)), None if weights is None else tuple(weights), tuple(sorted(context.items()))))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_keeps(f"scorer {name}", lambda: Scorer(terms, usual, weights, context))
        for batch in batches:
            both = [scorer.score(t.as_py()) for t in batch.column(1)]
            scores, found = [s for s, _ in both], [n for _, n in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, pa.int64())],
                names=["id", "score", "predicted", "n_matches"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(named(id_col).alias("id"), text_of(text_col).alias("text"))
    return frame.mapInArrow(run, f"id {kind}, score double, predicted int, n_matches bigint").withColumnRenamed("id", id_col)
