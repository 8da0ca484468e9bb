import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import texts_of
from snaptable.llm import language_id as lang
from snaptable.llm.common import remainder


@pytest.fixture(scope="module")
def model(corpus):
    return lang.fit(corpus, remainder("doc_id", 4) != 2)


def by_paths(scores, start, move):
    """Marginals from all label paths."""
    n, k = scores.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = start[path[0]] * np.prod([move[a, b] for a, b in itertools.pairwise(path)]) * np.prod([scores[t, y] for t, y in enumerate(path)])
        for t, y in enumerate(path):
            total[t, y] += weight
    return total / total.sum(axis=1, keepdims=True)


def test_posteriors_are_those_of_all_paths(model, monkeypatch):
    monkeypatch.setattr(lang, "SPAN", 3)  # so that pieces are joined
    tagger = lang.Tagger(model)
    words = "the sch ashing 12 ung whe - berlich ren ein torash aufung x".split()
    for n in range(1, len(words)):
        texts = [words[:n], [], words[-n:], ["12", "-"]]
        for tokens, found in zip(texts, tagger.posteriors(texts), strict=True):
            real = [t for t in tokens if lang.clean(t)]
            assert found.shape == (len(real), 2)
            if real:
                scores = np.stack([tagger.table[tagger.rows[t]] for t in real]).astype(float)
                assert np.allclose(found, by_paths(scores, tagger.start, tagger.move), atol=1e-6)


def test_training_gradient_counts_transitions():
    rng = np.random.default_rng(1)
    psi, start, move = rng.random((2, 4, 3)) + 0.1, rng.random(3) + 0.1, rng.random((3, 3)) + 0.1
    length = np.array([4, 2])
    psi[1, 2:] = 1.0
    marginal, pairs = lang._forward_backward(psi, start, move, length)
    assert np.allclose(marginal[0], by_paths(psi[0], start, move)) and np.allclose(marginal[1, :2], by_paths(psi[1, :2], start, move))
    assert pairs.sum() == pytest.approx(3 + 1)


def test_staying_is_learned(model):
    assert model.languages == ["xa", "xb"] and all(model.move[i, i] > model.move[i, 1 - i] for i in (0, 1))


def test_held_out_accuracy(corpus, model):
    found = lang.identify(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id").filter(remainder("doc_id", 4) == 2).collect()
    assert len(found) > 40 and sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_words_of_a_mixed_text_are_told_apart(model):
    text = "the renash toring whe ashren the ungsch berlich einauf schung lichber ein".split()
    labels = lang.Tagger(model).posteriors([text])[0].argmax(axis=1).tolist()
    assert labels == [0] * 6 + [1] * 6


def test_word_spans_of_a_mixed_text(spark, odd, none, model):
    text = "the renash  toring whe (ashren) the, 12 -- ungsch berlich einauf schung lichber ein!"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "12 --"), (4, "the renash the whe ashren")], "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in lang.word_spans(docs, model).collect()}
    assert [(text[s.start : s.end], s.lang) for s in found[1]] == [(text[:36], "xa"), (text[43:], "xb")]
    assert found[2] == found[3] == [] and [s.lang for s in found[4]] == ["xa"] and 0.5 < found[4][0].score <= 1
    assert {r.doc_id: r.n_switches for r in lang.identify(docs, model).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert lang.word_spans(odd, model).count() == odd.count() and lang.word_spans(none, model).count() == 0
    assert all(r.spans == [] for r in lang.word_spans(odd, None).collect())


def test_the_sample_counts_identifiers_once(spark):
    docs = [(i % 3, f"words of copy {i}", "en") for i in range(3000)] + [(9, "ein text", "de")] + [(None, "null one", "fr")] * 50
    found = lang.sample(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), "text", "lang", "doc_id", F.lit(True))
    assert sorted(y for _, y in found) == ["de", "en", "en", "en", "fr"]


def test_the_sample_comes_from_whole_texts(spark, monkeypatch):
    long = " ".join("".join(chr(97 + (i >> s) % 16) for s in (0, 4, 8, 12)) for i in range(20_000))
    docs = spark.createDataFrame([(i, f"{long} {chr(97 + i)}", "en") for i in range(20)], "doc_id bigint, text string, lang string")
    found = [t for t, _ in lang.sample(docs, "text", "lang", "doc_id", F.lit(True), per_language=10)]
    places = [long.find(t) / len(long) for t in found]
    assert len(found) == 40 and min(places) < 0.2 and max(places) > 0.8
    monkeypatch.setattr(lang, "MOST_LANGUAGES", 0)
    with pytest.raises(ValueError, match="languages"):
        lang.sample(docs, "text", "lang", "doc_id", F.lit(True))


def test_predictions_use_neither_labels_nor_identifiers_nor_batches(corpus, model):
    one = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(corpus, model).collect()}
    moved = corpus.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("zz").alias("lang")).coalesce(1)
    two = {r.doc_id - 1000: (r.lang_pred, r.score) for r in lang.identify(moved, model).collect()}
    assert all(one[i][0] == two[i][0] and one[i][1] == pytest.approx(two[i][1], abs=1e-6) for i in one)


def test_a_small_cache_changes_nothing(corpus, model, monkeypatch):
    texts = list(texts_of(corpus).values())
    whole = lang.Tagger(model).documents(texts)
    monkeypatch.setattr(lang, "CACHE_WORDS", 20)
    tagger = lang.Tagger(model)
    again = [x for t in texts for x in tagger.documents([t])]
    assert [a[::2] for a in again] == [a[::2] for a in whole] and np.allclose([b for _, b, _ in again], [b for _, b, _ in whole], atol=1e-6)


def test_rows_of_every_kind(odd, none, model):
    out = {r.doc_id: r for r in lang.identify(odd, model).collect()}
    assert lang.identify(odd, model).count() == odd.count() and lang.identify(none, model).count() == 0
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (0, 1, 2)) and out[7].lang_pred in ("xa", "xb")
    assert lang.fit(none, F.lit(True)) is None and {r.lang_pred for r in lang.identify(odd, None).collect()} == {"und"}
    kept = lang.keep_identified(odd, model, least=0.3)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3
    assert lang.fit(odd, F.lit(True)).languages == ["en"]
