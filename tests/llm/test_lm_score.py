import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import texts_of
from snaptable.llm import lm_score as lm
from snaptable.llm.common import remainder


class Plain:
    """The same model by dictionaries, walking down from the longest context of each symbol."""

    def __init__(self, texts):
        self.counts = {}
        for t in texts:
            raw = bytes([lm.START] * 5) + t.encode() + bytes([lm.END])
            for i in range(5, len(raw)):
                for k in range(6):
                    self.counts.setdefault(raw[i - k : i], Counter())[raw[i]] += 1

    def row(self, context):
        """Probabilities of all symbols after a context."""
        row, weight, excluded = np.zeros(256), 1.0, set()
        for k in range(len(context) + 1):
            n = self.counts.get(context[k:], {})
            left = {s: c for s, c in n.items() if s not in excluded}
            if left:
                total = sum(left.values())
                escape = len(left) / (total + len(left)) if len(n) < 255 else 0.0
                for s, c in left.items():
                    row[s] = weight * (1 - escape) * c / total
                weight *= escape
                excluded |= set(left)
        for s in set(range(256)) - excluded - {lm.START}:
            row[s] = weight / (255 - len(excluded))
        return row

    def score(self, text):
        raw = bytes([lm.START] * 5) + text.encode() + bytes([lm.END])
        return sum(math.log10(self.row(raw[i - 5 : i])[raw[i]]) for i in range(5, len(raw)))


def test_scores_as_by_dictionaries(spark, corpus, monkeypatch):
    held = remainder("doc_id", 7) == 2
    monkeypatch.setattr(lm, "HOT_WORDS", 50)
    texts = texts_of(corpus)
    out = {r.doc_id: r for r in lm.lm_score(corpus, held).collect()}
    train = [t for i, t in texts.items() if not out[i].held_out]
    plain, counts = Plain(train), Counter(w for t in train for w in [*t.split(), ""])
    n_all, below = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    for i, t in texts.items():
        words = [*t.split(), ""]
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n_all)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / below) for w in words))
    for i in list(texts)[:25]:
        assert out[i].score == pytest.approx(plain.score(texts[i]), rel=1e-5)


def strings(texts):
    """(codes, counts) of six-byte strings"""
    found = Counter()
    for t in texts:
        raw = bytes([lm.START] * 5) + t + bytes([lm.END])
        found.update(int.from_bytes(raw[i : i + 6], "big") for i in range(len(raw) - 5))
    codes = sorted(found)
    return np.array(codes, dtype=np.int64), np.array([float(found[c]) for c in codes], dtype=np.float64)


@pytest.mark.parametrize("texts", [[b"abracadabra abracadabra", b"cabal"], [bytes(range(256)) * 2, bytes(range(256))[::-1], b"xyz"], []])
def test_rows_are_distributions(texts):
    texts = [bytes(b for b in t if b not in (lm.START, lm.END)) for t in texts]
    code, n = strings(texts)
    three, at = np.unique(code & 0xFFFFFF, return_inverse=True)
    short = lm.ShortContexts(three, np.bincount(at, weights=n))
    for context in [b"\xfe" * 5, b"abrac", b"zabra", b"zzzra", b"zzzza", b"zzzzz", b"wxyzw"]:
        row = [int.from_bytes(context, "big") << 8 | s for s in range(256)]
        every = np.union1d(code, row)
        known = dict(zip(code.tolist(), n.tolist(), strict=True))
        p = lm.longer_contexts(every, np.array([known.get(c, 0.0) for c in every.tolist()]), short)
        found = p[np.searchsorted(every, row)]
        assert found[lm.START] == 0 and (np.delete(found, lm.START) > 0).all() and found.sum() == pytest.approx(1)


def test_a_very_long_text_goes_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(lm, "_PIECE", 1000)
    monkeypatch.setattr(lm, "_CHUNK", 1500)
    docs = spark.createDataFrame([(1, "the torash " * 900), (2, "another")], "doc_id bigint, text string")
    plain = Plain(["the torash " * 900, "another"])
    for r in lm.lm_score(docs, F.lit(False)).collect():
        assert r.score == pytest.approx(plain.score("the torash " * 900 if r.doc_id == 1 else "another"), rel=1e-5)


def test_held_out_text_of_the_same_kind_is_likelier(corpus):
    out = lm.lm_score(corpus, remainder("doc_id", 7) == 2).filter("held_out").collect()
    other = lm.lm_score(corpus.withColumn("text", F.when(remainder("doc_id", 7) == 2, F.reverse("text")).otherwise(F.col("text"))), remainder("doc_id", 7) == 2)
    reversed_ = {r.doc_id: r.score for r in other.filter("held_out").collect()}
    assert sum(r.score for r in out) > 0.7 * sum(reversed_.values())


def test_rows_of_every_kind(odd, none):
    held = remainder("doc_id", 7) == 2
    out = lm.lm_score(odd, held)
    assert out.count() == odd.count()
    empty = out.filter("doc_id = 0").head()
    assert empty.n_tokens == 1 and empty.score < 0
    assert out.filter("doc_id = 3").select("score").distinct().count() == 2 and out.filter("doc_id is null").count() == 1
    assert lm.lm_score(none, held).count() == 0
    unlearned = lm.lm_score(odd, F.lit(True)).filter("doc_id = 4").head()
    assert unlearned.train_tokens == 0 and unlearned.n_known == 0 and unlearned.score == pytest.approx(29 * -math.log10(255), rel=1e-5)


@pytest.mark.parametrize("most", [lm.HOT_GRAMS, 400, 0])
def test_every_context_counts_however_rare(spark, corpus, monkeypatch, most):
    # One text among many that are nothing like it: its contexts are far below 1/65,536 of all counts.
    monkeypatch.setattr(lm, "HOT_GRAMS", most)
    rare = "zyxwvu qpzyxw vutsrq"
    many = spark.range(1000, 1040).select(F.col("id").alias("doc_id"), F.lit("abcdefgh " * 4000).alias("text"))
    docs = many.unionByName(corpus.select("doc_id", "text").limit(40)).unionByName(
        spark.createDataFrame([(2000, rare), (2001, rare[::-1]), (2002, rare + " unmet")], "doc_id bigint, text string"))
    held = F.col("doc_id").isin(2001, 2002)
    texts = texts_of(docs)
    plain = Plain([t for i, t in texts.items() if i not in (2001, 2002)])
    out = {r.doc_id: r.score for r in lm.lm_score(docs, held).collect()}
    for i in (2000, 2001, 2002, *sorted(texts)[:3]):
        assert out[i] == pytest.approx(plain.score(texts[i]), rel=1e-5)


def test_the_end_is_known_when_no_word_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 1)
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    for r in lm.lm_score(docs, F.lit(False)).collect():  # 51 tokens, each with a count of 2
        assert (r.n_tokens, r.n_known) == (51, 51) and r.base_score == pytest.approx(51 * math.log10(3 / (102 + 51 + 1)))
