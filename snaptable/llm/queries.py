"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptable.llm.common import remainder, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.secrets import KINDS, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(column):
        place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        return F.concat_ws(",", F.transform(column, place))

    base = joined(F.filter("secrets", lambda s: s["kind"] != "guess"))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.round(F.array_max(F.transform("secrets", lambda s: s["log10_guesses"])), 3).alias("max_log10_guesses"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.lm_score import lm_score

    return lm_score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, remainder("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "n_switches")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.token_shards import token_shards

    return token_shards(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.line_quality import line_quality

    return line_quality(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_matches")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.mixing import mix

    found = mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    taken = F.col("mix.size") * F.col("mix.copies")
    return found.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"), "mix.copies", "mix.rate")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snaptable.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_decontamination, op3_url_filter, op4_lm_score, op5_language, op6_token_shards, op7_line_quality, op8_toxicity, op9_mixing, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    from snaptable.llm import line_quality, url_filter

    return {"op3_url_filter": url_filter.ORACLE, "op7_line_quality": line_quality.ORACLE}
