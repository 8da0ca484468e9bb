"""Language identification of code-switched text: a linear-chain conditional random field over words.

A word's evidence is the sum of weights of its affixes, character n-grams and lexicon entry; a
learned transition matrix ties neighbouring words. Training maximises the conditional likelihood on
pieces of a bounded sample of labelled texts (some of them spliced from two languages, so that switches are
seen), by Adagrad on exact forward-backward gradients. Prediction labels every word of the whole
text by its forward-backward posterior; a document's language is the one with the most posterior mass.
``word_spans`` gives the words' labels as spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptable.llm.common import named, rows_where, ship, text_of, worker_keeps

UNKNOWN = "und"
BUCKETS = 1 << 16  # hashed weights
SAMPLE_TEXTS = 200  # labelled texts of a language in the training sample
SAMPLE_PIECES = 4  # pieces of a sampled text, from anywhere in it
SEQUENCE = 48  # words of a piece, which is a training sequence
MOST_LANGUAGES = 1000  # the model is broadcast and has a column of 65,536 weights for each
SPAN = 64  # words of a piece in prediction
CACHE_WORDS = 300_000


class _Hashed(dict):
    """Hash numbers of strings; remembers some."""

    def __missing__(self, name: str) -> int:
        number = zlib.crc32(name.encode()) % BUCKETS
        if len(self) < 300_000:
            self[name] = number
        return number


_hashed = _Hashed()


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed feature numbers of a word: affixes of 1 to 3 letters, n-grams of 2 and 3, its lexicon entry."""
    w = f"<{word}>"
    names = [w[:2], w[:4], w[-2:], w[-4:]]  # the affixes of 2 are n-grams already
    names += map("".join, zip(word, word[1:], strict=False))
    names += map("".join, zip(w, w[1:], w[2:], strict=False))
    out = list(map(_hashed.__getitem__, names))
    entry = lexicon.get(word)
    if entry is not None:
        out.append(BUCKETS + entry)
    return out


def clean(token: str) -> str:
    """A token's word: lower case, without what is no letter at either end; '' if it has no letter."""
    if token.isalpha():
        return token.lower()
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return token[a:b].lower()


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # features x languages
    start: np.ndarray
    move: np.ndarray  # from language x to language

    @property
    def name(self) -> str:
        return hashlib.sha1(self.weights.tobytes() + self.move.tobytes() + self.start.tobytes()).hexdigest()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of evidence for each word; a word's features count by their mean, so long words don't dominate."""
        found = [features(w, self.lexicon) for w in words]
        sizes = np.array([len(f) for f in found])
        flat = np.fromiter((x for f in found for x in f), dtype=np.int64, count=int(sizes.sum()))
        sums = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        return (sums / np.sqrt(sizes)[:, None]).astype(np.float32)


def _forward_backward(psi: np.ndarray, start: np.ndarray, move: np.ndarray, length: np.ndarray):
    """Posteriors of padded sequences psi (sequence, time, language; positive) and expected transitions."""
    n, steps, k = psi.shape
    alpha, beta, scale = np.zeros_like(psi), np.ones_like(psi), np.ones((n, steps))
    for t in range(steps):
        a = start * psi[:, 0] if t == 0 else (alpha[:, t - 1] @ move) * psi[:, t]
        scale[:, t] = a.sum(axis=1)
        alpha[:, t] = a / scale[:, t, None]
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        live = (t + 1 < length)[:, None]
        ahead = psi[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        beta[:, t] = np.where(live, ahead @ move.T, 1.0)
        pairs += ((alpha[:, t] * live).T @ ahead) * move
    return alpha * beta, pairs


def words_of(text: str) -> list[str]:
    return [w for w in map(clean, text.split()) if w]


def pieces(text: str, name: str, most: int = SAMPLE_PIECES) -> list[str]:
    """Up to ``most`` runs of SEQUENCE words from the whole text, the first in hashed order of their places."""
    words = words_of(text)
    starts = sorted(range(0, len(words), SEQUENCE), key=lambda at: (xxhash.xxh64_intdigest(f"{name} {at}"), at))
    return [" ".join(words[at : at + SEQUENCE]) for at in sorted(starts[:most])]


def train(rows: list[tuple[str, str]], epochs: int = 8, seed: int = 7) -> Model | None:
    """Fits the field on (piece of a text, language) rows; None without a row that has words."""
    rows = [(t, y) for t, y in rows if t and y is not None]
    languages = sorted({y for _, y in rows})
    place = {y: i for i, y in enumerate(languages)}
    labelled = [(words_of(t), place[y]) for t, y in rows]
    labelled = [x for x in labelled if x[0]]
    if not labelled:
        return None
    rng = np.random.default_rng(seed)
    counts = [Counter() for _ in languages]
    for words, y in labelled:
        counts[y].update(set(words))
    lexicon = {w: i for i, w in enumerate(sorted({w for c in counts for w, n in c.items() if n >= 3}))}
    sequences: list[tuple[list[str], list[int]]] = [(words[:SEQUENCE], [y] * len(words[:SEQUENCE])) for words, y in labelled]
    for k in rng.integers(0, len(labelled), (len(labelled) // 8, 2)):  # spliced texts
        (a, x), (b, y) = labelled[k[0]], labelled[k[1]]
        i, j = rng.integers(1, SEQUENCE), rng.integers(1, SEQUENCE)
        words, tags = a[:i] + b[:j], [x] * len(a[:i]) + [y] * len(b[:j])
        sequences.append((words[:SEQUENCE], tags[:SEQUENCE]))
    k = len(languages)
    vocabulary = sorted({w for words, _ in sequences for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    found = [features(w, lexicon) for w in vocabulary]
    sizes = np.array([len(f) for f in found])
    flat = np.fromiter((x for f in found for x in f), dtype=np.int64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(found)), sizes)
    part = (1 / np.sqrt(sizes))[owner]
    used, local = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    weights, seen = np.zeros((len(used), k)), np.full((len(used), k), 1e-2)
    start, move = np.zeros(k), np.zeros((k, k))
    seen_start, seen_move = np.full(k, 1e-2), np.full((k, k), 1e-2)
    steps = max(len(w) for w, _ in sequences)
    order = rng.permutation(len(sequences))
    for _ in range(epochs):
        for at in range(0, len(order), 512):
            batch = [sequences[i] for i in order[at : at + 512]]
            length = np.array([len(w) for w, _ in batch])
            words, tags = np.zeros((len(batch), steps), dtype=np.int64), np.zeros((len(batch), steps), dtype=np.int64)
            for r, (w, y) in enumerate(batch):
                words[r, : len(w)], tags[r, : len(w)] = [number[x] for x in w], y
            scores = np.add.reduceat(weights[local] * part[:, None], starts, axis=0)[words]
            psi = np.exp(scores - scores.max(axis=2, keepdims=True))
            inside = np.arange(steps) < length[:, None]
            psi[~inside] = 1.0
            first, trans = np.exp(start - start.max()), np.exp(move - move.max())
            marginal, pairs = _forward_backward(psi, first, trans, length)
            gold = np.eye(k)[tags]
            error = (gold - marginal) * inside[:, :, None]
            by_word = np.zeros((len(vocabulary), k))
            np.add.at(by_word, words.ravel(), error.reshape(-1, k))
            grad = np.stack([np.bincount(local, weights=by_word[owner, j] * part, minlength=len(used)) for j in range(k)], axis=1)
            grad = grad / len(batch) - 1e-4 * weights
            seen += grad**2
            weights += 0.5 * grad / np.sqrt(seen)
            g = (gold[:, 0] - marginal[:, 0]).mean(axis=0)
            seen_start += g**2
            start += 0.1 * g / np.sqrt(seen_start)
            both = inside[:, 1:]
            observed = np.zeros((k, k))
            np.add.at(observed, (tags[:, :-1][both], tags[:, 1:][both]), 1.0)
            g = (observed - pairs) / len(batch) - 1e-3 * move
            seen_move += g**2
            move += 0.1 * g / np.sqrt(seen_move)
    full = np.zeros((BUCKETS + len(lexicon), k), dtype=np.float32)
    full[used] = weights
    return Model(languages, lexicon, full, start, move)


class Tagger:
    """Applies a model to many texts at once, with a bounded cache of tokens and word scores."""

    def __init__(self, model: Model):
        self.model = model
        self.start = np.exp(model.start - model.start.max())
        self.move = np.exp(model.move - model.move.max())
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}  # token: row of its word; row 0 is for tokens without a letter
        self.words: dict[str, int] = {"": 0}
        self.table = np.ones((1, len(self.model.languages)), dtype=np.float32)

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        """The row of each token's word in ``table``."""
        if len(self.rows) > CACHE_WORDS:  # only what these tokens need stays
            used = set(tokens)
            rows = {t: r for t, r in self.rows.items() if t in used}
            held = {r: w for w, r in self.words.items()}
            kept = sorted(set(rows.values()) - {0})
            place = {0: 0} | {r: i for i, r in enumerate(kept, 1)}
            self.table = self.table[[0, *kept]]
            self.words = {held[r]: i for r, i in place.items()}
            self.rows = {t: place[r] for t, r in rows.items()}
        rows, words = self.rows, self.words
        missing = [(t, clean(t)) for t in set(tokens).difference(rows)]
        new = sorted({w for _, w in missing if w not in words})
        if new:
            scores = self.model.word_scores(new)
            words.update((w, i) for i, w in enumerate(new, len(self.table)))
            self.table = np.concatenate([self.table, np.exp(scores - scores.max(axis=1, keepdims=True))])
        rows.update((t, words[w]) for t, w in missing)
        return np.fromiter(map(rows.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text's tokens that hold a letter, a row of language probabilities each.

        Texts are cut into pieces of SPAN tokens; products of transition matrices carry the
        messages over the pieces, so a long text costs no more steps than a short one."""
        k = len(self.start)
        number = self._numbers([x for t in texts for x in t])
        sizes = np.array([len(t) for t in texts])
        real = number > 0
        counts = np.concatenate([[0], np.cumsum(real)])
        ends = np.cumsum(sizes)
        sizes = counts[ends] - counts[ends - sizes]
        number = number[real]
        pieces = -(-sizes // SPAN)
        first = np.concatenate([[0], np.cumsum(pieces)])
        offset = np.concatenate([[0], np.cumsum(sizes)])
        total = int(first[-1])
        if not total:
            return [np.zeros((0, k)) for _ in texts]
        text = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(len(text)) - offset[text]
        piece, step = first[text] + inside // SPAN, inside % SPAN
        psi = np.ones((SPAN, total, k))
        psi[step, piece] = self.table[number]
        real = np.zeros((SPAN, total), dtype=bool)
        real[step, piece] = True
        head = np.zeros(total, dtype=bool)
        head[first[:-1][pieces > 0]] = True
        # What a piece does to a message from its left: a matrix; a text's first step has the start weights.
        carry = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for t in range(SPAN):
            stepped = (carry.reshape(-1, k) @ self.move).reshape(total, k, k)
            if t == 0:
                stepped[head] = np.broadcast_to(self.start, (k, k))
            stepped *= psi[t][:, None, :]
            stepped /= stepped.sum(axis=(1, 2), keepdims=True)
            carry = np.where(real[t][:, None, None], stepped, carry)
        left, right = np.full((total, k), 1 / k), np.full((total, k), 1 / k)
        for j in range(1, int(pieces.max())):
            at = first[:-1][pieces > j] + j
            m = (left[at - 1][:, None, :] @ carry[at - 1])[:, 0]
            left[at] = m / m.sum(axis=1, keepdims=True)
        for j in range(1, int(pieces.max())):
            at = first[1:][pieces > j] - 1 - j
            m = (carry[at + 1] @ right[at + 1][:, :, None])[:, :, 0]
            right[at] = m / m.sum(axis=1, keepdims=True)
        alpha = np.empty((SPAN, total, k))
        a = left
        for t in range(SPAN):
            b = a @ self.move
            if t == 0:
                b[head] = self.start
            b = b * psi[t]
            b /= b.sum(axis=1, keepdims=True)
            a = np.where(real[t][:, None], b, a)
            alpha[t] = a
        b = right
        out = np.empty((SPAN, total, k))
        for t in range(SPAN - 1, -1, -1):
            both = alpha[t] * b
            out[t] = both / both.sum(axis=1, keepdims=True)
            back = (psi[t] * b) @ self.move.T
            b = np.where(real[t][:, None], back / back.sum(axis=1, keepdims=True), b)
        found = out[step, piece]
        return [found[offset[i] : offset[i + 1]] for i in range(len(texts))]

    def documents(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """(language, mean posterior of it over the tokens that hold a letter, changes of language) for each text."""
        out = []
        for rows in self.posteriors([t.split() for t in texts]):
            if not len(rows):
                out.append((UNKNOWN, 0.0, 0))
                continue
            mean, each = rows.mean(axis=0), rows.argmax(axis=1)
            best = int(mean.argmax())
            out.append((self.model.languages[best], float(min(1.0, mean[best])), int(np.count_nonzero(each[1:] != each[:-1]))))
        return out

    def spans(self, texts: list[str]) -> list[list[dict]]:
        """Runs of words of one likeliest language: code points, end exclusive, and the mean posterior.

        Tokens without a letter have no label and end no run."""
        found, out = [[m for m in _TOKEN.finditer(t)] for t in texts], []
        for tokens, rows in zip(found, self.posteriors([[m.group() for m in f] for f in found]), strict=True):
            real = [m for m in tokens if clean(m.group())]
            if not real:
                out.append([])
                continue
            each = rows.argmax(axis=1)
            edges = np.flatnonzero(np.diff(each, prepend=-1)).tolist()
            runs = []
            for a, b in zip(edges, [*edges[1:], len(real)], strict=True):
                language = int(each[a])
                runs.append({"start": real[a].start(), "end": real[b - 1].end(), "lang": self.model.languages[language], "score": float(min(1.0, rows[a:b, language].mean()))})
            out.append(runs)
        return out


_TOKEN = re.compile(r"\S+")


def sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, learn: Column, per_language: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """(piece, language): SAMPLE_PIECES pieces of up to ``per_language`` labelled texts of each language.

    The texts are the first in hashed order of their identifiers, one text for each identifier (of several the first in
    hashed order); one without an identifier goes by its text. Rows with a null text or language are left out; a language with fewer
    texts gives all it has. More than MOST_LANGUAGES languages are an error. The draw is a top-k aggregate for each language,
    pieces are cut by the executors, and only they reach the driver."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.filter(learn & named(lang_col).isNotNull() & named(text_col).isNotNull())
    rows = rows.select(named(lang_col).cast("string").alias("lang"), named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text"))
    name = F.coalesce(F.concat(F.lit("="), "id"), F.xxhash64("text").cast("string"))
    names = rows.select("lang", name.alias("name")).distinct().withColumn("h", F.xxhash64("name", F.lit(11)))
    counts = names.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if counts.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # A hash threshold for each language leaves about 1.5 times what is needed; the exact cut is made below.
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language + 50) / F.col("n"))
    thin = names.join(F.broadcast(counts), "lang").filter(F.pmod(F.col("h"), F.lit(1_000_003)) < share * 1_000_003)
    chosen = thin.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "name"))), 1, per_language).alias("kept"))
    keep = chosen.select("lang", F.explode("kept").alias("k")).select("lang", F.col("k.name").alias("name"))  # at most MOST_LANGUAGES * per_language
    texts = rows.withColumn("name", name).join(F.broadcast(keep), ["lang", "name"], "left_semi")
    texts = texts.groupBy("lang", "name").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, names, found = [], [], []
            for lang, name, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for piece in pieces(text, name):
                    langs.append(lang)
                    names.append(name)
                    found.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (langs, names, found)], names=["l", "name", "t"])

    found = texts.mapInArrow(cut, "l string, name string, t string").collect()
    return [(r["t"], r["l"]) for r in sorted(found, key=lambda r: (r["l"], r["name"], r["t"]))]


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model that ``train`` fits on ``sample`` of the rows where ``learn`` holds; None if there is nothing to learn from.

    Repeated rows count once; the order of rows, and columns besides the three named, change nothing."""
    return train(sample(docs, text_col, lang_col, id_col, learn))


def _tagger(name: str, shared) -> Tagger | None:
    """The worker's tagger for a model; it keeps its cache from task to task."""
    return worker_keeps(f"tagger {name}", lambda: Tagger(shared.value)) if name else None


def _labels(label: Callable[[list[str]], list], texts: pa.Array) -> list:
    """What ``label`` says of each text, some of them at a time."""
    out, held, size = [], [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > 1_500_000:
            out += label(held)
            held, size = [], 0
    return out + (label(held) if held else [])


def _unknown(texts: list[str]) -> list[tuple[str, float, int]]:
    return [(UNKNOWN, 0.0, 0)] * len(texts)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: identifier, ``lang_pred``, ``score`` (0 to 1), ``n_switches`` (changes of language between words).

    ``und`` with score 0 for a null text, a text without a letter, and for every text if the model is
    None (nothing to learn from). Equal means go to the first language in order. Repeated rows stay; an empty table
    gives no rows; other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    shared, name = spark.sparkContext.broadcast(model), model.name if model else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(name, shared)
        for batch in batches:
            found = _labels(tagger.documents if tagger else _unknown, batch.column(1))
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "lang_pred", "score", "n_switches"])

    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(named(id_col).alias("id"), text_of(text_col).alias("text"))
    return frame.mapInArrow(run, f"id {kind}, lang_pred string, score double, n_switches bigint").withColumnRenamed("id", id_col)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))


def word_spans(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: identifier and ``spans``, the runs of words of one language (start, end, lang, score).

    Places are code points of the text, the end exclusive. Null texts, texts without a letter, and all if the
    model is None, have no spans; repeated rows stay; an empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    shared, name = spark.sparkContext.broadcast(model), model.name if model else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(name, shared)
        for batch in batches:
            found = _labels(tagger.spans if tagger else lambda texts: [[]] * len(texts), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(named(id_col).alias("id"), text_of(text_col).alias("text"))
    spans = "array<struct<start:bigint,end:bigint,lang:string,score:double>>"
    return frame.mapInArrow(run, f"id {kind}, spans {spans}").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", least: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, all columns as they are.

    Without ``least`` it is 1.2 times the share that a text of all languages in equal parts gives each, at most 0.9. Null texts,
    texts without a letter, and all if the model is None, leave; repeated rows stay; an empty table gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    shared, name = spark.sparkContext.broadcast(model), model.name if model else ""
    if least is None:
        least = min(0.9, 1.2 / len(model.languages)) if model else 0.9

    def test() -> Callable[[pa.Array], list[bool]]:
        tagger = _tagger(name, shared)
        return lambda texts: [x != UNKNOWN and y >= least for x, y, _ in _labels(tagger.documents if tagger else _unknown, texts)]

    return rows_where(docs, text_col, test)
