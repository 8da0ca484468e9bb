import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as p
from llm_helpers import rows
from snaptable.llm import decontaminate, shingles
from snaptable.llm.queries import queries

BIG = "/root/testdata/sf0.1"


@pytest.fixture
def folder(spark, corpus, tmp_path):
    docs = corpus.select("*", F.lit(1).alias("n_chars"))
    bench = docs.filter("doc_id = 7").select(F.lit(1).cast("bigint").alias("item_id"), F.substring("text", 1, 120).alias("text"))
    extra = docs.filter("doc_id in (8, 9)").withColumn("text", F.when(F.col("doc_id") == 8, F.lit(None)).otherwise("123 -- 456")).withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_each_stage_does_its_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, folder).cache()
        seen[name] = out
        if name != p.STAGES[-1][0]:
            assert out.columns == columns and out.exceptAll(docs.join(out.select("doc_id").distinct(), "doc_id").select(*columns)).filter("false").count() == 0
        docs = out
    ids = {n: {r.doc_id for r in f.select("doc_id").collect()} for n, f in seen.items()}
    assert {1008, 1009}.isdisjoint(ids["language"]) and set(range(300)) == ids["language"]
    groups = shingles.near_duplicates(seen["language"]).groupBy("component_id").count()
    assert ids["near_duplicates"] == {r.component_id for r in groups.collect()}
    leaks = decontaminate.find_leaks(seen["near_duplicates"], spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert ids["near_duplicates"] - ids["benchmark_leaks"] == {r.doc_id for r in leaks.collect()} >= {7}
    assert seen["source_mix"].count() == seen["token_output"].count() and ids["source_mix"] == ids["token_output"]
    assert rows(p.run(spark, folder).groupBy("doc_id", "n_tokens").count()) == rows(seen["token_output"].groupBy("doc_id", "n_tokens").count())


def test_an_empty_table_goes_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)} and set(queries()) < names
    assert p.ORACLE_SQL is None and set(entry.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test data here")
@pytest.mark.parametrize("name", ["op5_language", "op8_toxicity"])
def test_held_out_quality_on_the_small_tables(spark, name):
    found = queries()[name](spark, BIG).filter("held_out")
    if name == "op5_language":
        truth = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
        right = found.join(truth, "doc_id").filter("lang is not null").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("x"))
        assert right.agg(F.avg("x")).head()[0] >= 0.9
    else:
        truth = spark.read.parquet(f"{BIG}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        both = found.join(truth, "doc_id").select("toxic", "predicted", "score").collect()
        hits = sum(r.toxic == r.predicted == 1 for r in both)
        # Some labels there are wrong both ways, so the best that can be reached is below 1.
        assert hits >= 0.8 * sum(r.toxic == 1 for r in both) > 0 and hits >= 0.8 * sum(r.predicted for r in both)
        assert found.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
