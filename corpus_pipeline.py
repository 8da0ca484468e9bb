"""A corpus pipeline: language, near duplicates, benchmark leaks, source mix, token shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written
as Parquet and read again as the next one's documents. All but the last return the columns of
``documents``; the last returns a row for each document copy as read back from the token shards.
Null identifiers, null or empty texts, repeated rows and empty tables go through every stage as its
operator's docstring says: documents without a letter leave at the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snaptable.llm import decontaminate, language_id, mixing, simhash, token_shards
from snaptable.llm.common import remainder, shared_path, table
from snaptable.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known."""
    model = language_id.fit(docs, remainder("doc_id", 4) != 2)
    return language_id.keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group that SimHash, or 0.8 of the five-word shingles, connects."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources meet their token targets."""
    return mixing.repeated(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and reads them back."""
    return token_shards.token_shards(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Fingerprints, forward-backward, edit distance and tokenization have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
