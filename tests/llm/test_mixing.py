import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import rows
from snaptable.llm import mixing

COLUMNS = ["doc_id", "mix"]


def shared_out(totals, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets, by giving the excess back round by round."""
    names = sorted(totals, key=lambda n: (n is None, (n or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, stopped = share * sum(totals.values()), set()
    while True:
        open_ = [n for n in names if n not in stopped]
        left = budget - sum(cap * totals[n] for n in stopped)
        found = {n: cap * totals[n] if n in stopped else left * w[n] / sum(w[m] for m in open_) for n in names}
        above = {n for n in open_ if found[n] > cap * totals[n]}
        if not above:
            return found
        stopped |= above


@pytest.mark.parametrize("totals", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 3, "d": 50, None: 7, "é": 0}, {"a": 5}, {"b": 100, "B": 1, "aa": 1}])
def test_targets_as_shared_out_round_by_round(spark, totals):
    key = lambda n: "1" if n is None else f"0{n}"
    frame = spark.createDataFrame([(key(n), t) for n, t in totals.items()], "key string, total bigint")
    found = {r.key: r.target for r in mixing.targets(frame).collect()}
    assert found == pytest.approx({key(n): t for n, t in shared_out(totals).items()})


@pytest.fixture(scope="module")
def mixed(corpus):
    return mixing.mix(corpus).cache()


def test_targets_and_words_taken(corpus, mixed):
    totals, taken = {}, {}
    for r in mixed.collect():
        assert r.mix.size == len((r.text or "").split()) and 0 <= r.mix.copies <= 2 and r.mix.copies in (math.floor(r.mix.rate), math.ceil(r.mix.rate))
        totals[r.source] = totals.get(r.source, 0) + r.mix.size
        taken[r.source] = taken.get(r.source, 0) + r.mix.size * r.mix.copies
    wanted = shared_out(totals)
    longest = max(r.mix.size for r in mixed.collect())
    for r in mixed.collect():
        assert r.mix.source_size == totals[r.source] and r.mix.target == pytest.approx(wanted[r.source])
    assert all(abs(taken[s] - wanted[s]) <= longest for s in wanted)


def test_rates_solve_the_dual(mixed):
    """The rates' tokens meet the target, and their logarithms are proportional to the sizes until the cap."""
    by = {}
    for r in mixed.collect():
        by.setdefault(r.source, []).append((r.mix.size, r.mix.rate, r.mix.target, r.mix.source_size))
    for found in by.values():
        assert sum(s * x for s, x, *_ in found) == pytest.approx(found[0][2], rel=1e-6)
        free = [(s, math.log(x)) for s, x, *_ in found if s and 0 < x < 2 - 1e-12]
        if found[0][2] < 2 * found[0][3] and len(free) > 1:
            slopes = np.array([y / s for s, y in free])
            assert np.allclose(slopes, slopes[0], rtol=1e-6, atol=1e-9)


def test_reruns_agree_however_the_rows_lie(corpus, mixed):
    again = mixing.mix(corpus.repartition(11, "text")).select(*COLUMNS)
    assert rows(again) == rows(mixed.select(*COLUMNS))


def test_many_sources_are_joined_with_a_salt(corpus, mixed, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows(mixing.mix(corpus).select(*COLUMNS)) == rows(mixed.select(*COLUMNS))


def test_small_buckets_still_come_near(corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    sums = mixing.mix(corpus).groupBy("source").agg(F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.max("mix.target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.15 * r.target for r in sums)


def test_the_mix_repeats_rows(corpus, mixed):
    taken = mixing.repeated(corpus)
    assert taken.schema == corpus.schema and taken.count() == mixed.agg(F.sum("mix.copies")).head()[0]


def test_rows_of_every_kind(odd, none):
    out = mixing.mix(odd)
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    assert all(r.mix.copies == 1 and r.mix.size == 0 for r in out.filter("doc_id < 3").collect())
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0
    wordless = mixing.mix(odd.filter("doc_id < 3"))
    assert wordless.agg(F.sum("mix.copies")).head()[0] == 3


def test_a_row_repeated_many_times_fills_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    docs = [(1, "one and the same row", "s")] * 900 + [(i, "w " * (i % 9 + 1), "st"[i % 2]) for i in range(2, 400)] + [(None, "x y", None)] * 50
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    found = mixing.mix(docs)
    assert found.count() == docs.count() and rows(found.select("doc_id", "mix")) == rows(mixing.mix(docs.repartition(7)).select("doc_id", "mix"))
    sums = found.groupBy("source").agg(F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.max("mix.target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.1 * r.target for r in sums)


def test_places_are_those_of_one_sort(spark):
    keys = [f"0{i * 7919 % 1000}" for i in range(1000)] + ["1"]
    frame = spark.createDataFrame([(k, 1) for k in keys], "key string, total bigint").repartition(5)
    found = {r.key: r.place for r in mixing.placed(frame).collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys))}


def test_what_does_not_converge_is_an_error(corpus):
    sized = corpus.sparkSession.createDataFrame([("0a", 5, 10, 95, 16, 120.0), ("0a", 9, 5, 95, 16, 120.0)], "key string, size bigint, n bigint, total bigint, docs bigint, target double")
    with pytest.raises(RuntimeError, match="converge"):
        mixing.multipliers(sized.withColumn("mean", F.lit(6.3)), most_steps=1)


def test_nothing_runs_in_python(corpus):
    plan = mixing.mix(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
