import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_helpers import texts_of
from snaptable.llm import shingles as sh
from snaptable.llm import simhash


def sets(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def made():
    """Texts with copies that differ in some words: similarities on both sides of 0.8."""
    rng = random.Random(11)
    out = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200)))) for i in range(40)]
    for i in range(40, 160):
        words = out[rng.randrange(40)][1].split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{i}"
        out.append((i, " ".join(words)))
    return out


def connected(texts):
    """The least identifier that links reach, by all pairs: four bits or fewer apart, or shingle sets alike by 0.8."""
    found = {i: sets(" ".join(t.lower().split())) for i, t in texts.items()}
    bits = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    root = {i: i for i in found}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in found:
        for b in found:
            if a < b and ((bits[a] ^ bits[b]).bit_count() <= 4 or len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b])):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in found}


@pytest.mark.parametrize("bounds", [{}, {"group_rows": 3}, {"group_shingles": 400}])
def test_components_are_those_of_all_pairs(spark, bounds):
    docs = spark.createDataFrame(made(), "doc_id bigint, text string").repartition(3)
    wanted = connected(texts_of(docs))
    assert len(set(wanted.values())) < 100
    assert {r.doc_id: r.component_id for r in sh.near_duplicates(docs, **bounds).collect()} == wanted


def test_one_document_of_each_group_stays(corpus):
    kept = simhash.keep_one(corpus)
    assert kept.schema == corpus.schema and sorted(r.doc_id for r in kept.collect()) == sorted(set(connected(texts_of(corpus)).values()))


def test_the_pipeline_mixes_one_of_texts_alike_by_four_fifths(spark):
    words = [f"w{i}" for i in range(200)]
    near, far = list(words), list(words)
    near[30], near[90], near[150] = "x", "y", "z"  # 181 of 211 shingles
    far[20::40] = ["q"] * 5
    far[1::20] = ["r"] * 10
    docs = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far))]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES[1:]:
        if name == "source_mix":
            break
        if name != "benchmark_leaks":
            docs = stage(spark, docs, "")
    assert sorted(r.doc_id for r in docs.collect()) == [0, 2]


def test_rows_of_every_kind(odd, none):
    out = sh.near_duplicates(odd)
    assert out.count() == odd.count() and sh.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 3").count() == 1 and kept.filter(F.col("doc_id").isNull()).count() == 1
    assert kept.filter("doc_id < 3").count() == 1
