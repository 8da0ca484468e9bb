import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaptable.llm import toxicity as tox


def edits(word, term):
    """Plain edit distance; a lookalike of a letter costs nothing."""
    before = list(range(len(term) + 1))
    for i, c in enumerate(word, 1):
        now = [i]
        for j, t in enumerate(term, 1):
            same = c == t or tox.LOOKALIKES.get(c) == t
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (not same)))
        before = now
    return before[-1]


TERMS = ["abcde", "abcdefgh", "cab", "bbbbbbbb", "dead", "decade", "caded*", "bcdabcdea*", "ace*"]


def nearest(word, terms):
    """The nearest term by plain distances; a stem's is that of the nearest beginning of the word."""
    near = []
    for n, t in enumerate(sorted(terms)):
        if t.endswith("*"):
            d, most = min(edits(word[:k], t[:-1]) for k in range(len(word) + 1)), tox.stem_budget(t[:-1])
        else:
            d, most = edits(word, t), tox.budget(t)
        if d <= most:
            near.append((d, t.endswith("*"), n, t))
    return (min(near)[3], min(near)[0]) if near else None


@settings(max_examples=800, deadline=None)
@given(st.text("abcde03", max_size=14) | st.tuples(st.sampled_from(TERMS), st.integers(0, 9), st.text("abcde", max_size=4)).map(lambda x: x[0].rstrip("*")[: x[1]] + x[2] + x[0].rstrip("*")[x[1] + 1 :] + x[2]))
def test_matches_are_those_of_the_plain_distance(word):
    assert tox.LexiconAutomaton(TERMS).match(word) == nearest(word, TERMS)


def test_stems_and_few_states(monkeypatch):
    a = tox.LexiconAutomaton(["low*", "lowest", "moron"])
    assert a.match("lowei") == ("low*", 0) and a.match("lowest") == ("lowest", 0) and a.match("lo") is None
    assert a.match("m0r0n") == ("moron", 0) and a.match("morron") == ("moron", 1) and a.match("lowezt") == ("low*", 0)
    monkeypatch.setattr(tox, "_STATES", 3)
    assert [a.match(w) for w in ("lowei", "morron", "xxxxx", "m0r0n")] == [("low*", 0), ("moron", 1), None, ("moron", 0)]


def test_quotation_weighs_less_than_address():
    s = tox.Scorer(["moron"], set(), None)
    weight = lambda t: s.matches(t)[0][3]
    plain = weight("one two moron three four")
    assert weight('he said "what a moron" and left') < weight("they called him moron once") < plain < weight("you are a moron .")


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    syllables = ["the", "on", "er", "ash", "ing", "tor", "lo", "ma"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(10, 80))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "Worthless.", "vermin,", f"loath{rng.choice(syllables)}"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_learned_words_score_held_out_texts(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = tox.fit(d, y, F.col("doc_id") % 5 != 0)
    assert len(model) == 4 and {"scumbag", "worthless", "vermin"} <= set(model[0]) and any(t.startswith("loath") for t in model[0])
    out = {r.doc_id: r for r in tox.score(d, model).collect()}
    held = [i for i, _ in docs if i % 5 == 0]
    assert all(out[i].predicted == dict(labels)[i] for i in held) and all(0 <= r.score <= 1 for r in out.values())
    spelled = spark.createDataFrame([(1, "the ashing w0rthle5s tor"), (2, "the ashing worthles tor"), (3, "the ashing tor")], "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in tox.score(spelled, model).collect()}
    assert scores[1] > 0.5 and scores[2] > scores[3]
    changed = y.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.fit(d, changed, F.col("doc_id") % 5 != 0)[0] == model[0]  # held-out labels teach nothing


def test_window_words_are_learned_in_every_language(spark):
    """Terms that others report are told from terms of address, by words of two languages that no list names."""
    rng = random.Random(8)
    tongues = {"xa": (["ren", "tor", "ash", "whe"], ["kwoth"], ["thuu", "yarr"]), "xb": (["sch", "ung", "ber"], ["sagter"], ["duh", "ihrr"])}
    docs, labels = [], []
    for i in range(3200):
        plain, report, address = tongues["xa" if i % 2 else "xb"]
        words = ["".join(rng.choices(plain, k=rng.randint(1, 3))) for _ in range(rng.randint(25, 40))]
        kind, at = i // 2 % 16, rng.randrange(3, 10)
        words[-1 - rng.randrange(3)] = rng.choice(report + address)  # far from any term
        if kind < 6:  # reported, or addressed
            words[at] = rng.choice(["scumbag", "vermin"])
            words[at - 1 - rng.randrange(2)] = rng.choice(report if kind == 0 else address)
        docs.append((i, " ".join(words)))
        labels.append((i, int(0 < kind < 6)))
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = tox.fit(d, y, F.col("doc_id") % 5 != 0)
    for plain, report, address in tongues.values():
        assert all(model[3][r] < -0.3 for r in report) and all(model[3][a] > 0.3 for a in address) and all(abs(model[3].get(p, 0)) < 0.3 for p in plain)
        pair = [(1, f"{plain[0]} {report[0]} scumbag {plain[1]}"), (2, f"{plain[0]} {address[0]} scumbag {plain[1]}")]
        scores = {r.doc_id: r.score for r in tox.score(spark.createDataFrame(pair, "doc_id bigint, text string"), model).collect()}
        assert scores[1] < 0.5 < scores[2]


def test_repeated_identifiers_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(i % 4, f"text number {i}") for i in range(2000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 4, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    found = tox.labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic")
    assert sorted((r.id, r.toxic) for r in found.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_logistic_regression_reaches_its_optimum():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(200, 2)), np.ones(200)]
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ np.array([2.0, -1.0, 0.3])))).astype(float)
    w = tox.logistic(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + np.array([1, 1, 1e-3]) * w).max() < 1e-6 and w[0] > 1 > 0 > w[1]


@pytest.mark.parametrize("label", [0, 1])
def test_rows_of_every_kind(spark, odd, none, label):
    labels = spark.createDataFrame([(3, label, 1), (3, label, 1), (None, 1, 1), (4, None, 1), (77, 1, 1)], "doc_id bigint, toxic int, text int")
    model = tox.fit(odd, labels, F.lit(True))
    out = tox.score(odd, model)
    assert out.count() == odd.count() and tox.score(none, model).count() == 0
    assert tox.score(odd, tox.fit(none, labels.limit(0), F.lit(True))).agg(F.max("score"), F.max("predicted")).head()[:] == (0.0, 0)
    assert out.filter("doc_id = 3").select("score").distinct().count() >= 1
