import random

import duckdb
from pyspark.sql import functions as F

from llm_helpers import rows, texts_of
from snaptable.llm import line_quality as lq

NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_lines", "common_chars"]


def own(text):
    """A text's own counts, by their definitions."""
    words = text.encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def made(n=80):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lines = [" ".join(rng.choices(["a", "b", "É#", "cc", "d|"], k=rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            lines.append("Common  LINE of this\there source and nothing else at all")
        if i % 7 == 0:
            lines += lines[:3] * 2
        out.append((i, "\n".join(lines) + "\r\v" * (i % 2), ["s1", "s2", None][i % 3]))
    return out


def test_counts_by_their_definitions(spark):
    docs = spark.createDataFrame(made(), "doc_id bigint, text string, source string").repartition(3)
    texts = texts_of(docs)
    for r in lq.line_quality(docs).collect():
        assert tuple(r)[1:6] == own(texts[r.doc_id])


def test_a_long_text_of_repeats(spark):
    text = " ".join(f"w{i % 1000}" for i in range(30_000)) + " " + " ".join(f"x{i}" for i in range(30_000))
    r = lq.line_quality(spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")).head()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (60_000, 30_000, True)


def test_documents_of_common_lines_go_and_others_stay(spark):
    own_words = lambda i: " ".join(f"own{i}word{j}" for j in range(30))
    boiler = " ".join(f"menu{j}" for j in range(40))
    docs = [(i, f"{boiler.upper()}\n\n  {boiler}  ", "hot") for i in range(30)]
    docs += [(i, f"{boiler}\n{own_words(i)}\n{own_words(-i)}", "hot") for i in range(30, 60)] + [(i, f"{boiler}\nfew", f"host{i}") for i in range(60, 90)]
    out = {r.doc_id: r for r in lq.line_quality(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert not any(out[i].kept for i in range(30)) and not any(out[i].base_failed for i in range(90))
    assert all(out[i].kept for i in range(30, 90))


def test_copies_of_one_document_are_one_document(spark):
    own_words = " ".join(f"own{j}" for j in range(40))
    docs = [(1, own_words, "s")] * 12 + [(None, own_words + " none", "s")] * 12 + [(i, f"own {i} {own_words} twelve", "s") for i in range(2, 4)] * 6
    docs += [(i, own_words + "\nof eleven", "t") for i in range(10, 21)]
    out = lq.line_quality(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
    assert len(out) == len(docs) and all(r.kept == (r.doc_id is None or r.doc_id < 10) for r in out)
    assert {(r.n_common_lines, r.common_chars) for r in out if not r.kept} == {(2, len(own_words) + 9)}


def test_in_a_large_host_an_absolute_limit_holds(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("shared line\nline "), "id").alias("text"), F.lit("s").alias("source"))
    lines = lambda **how: {r.n_common_lines for r in lq.line_quality(docs, most_share=2.0, **how).collect()}
    assert lines() == {0} and lines(most_docs=500) == {1}


def test_the_sql_agrees(spark, odd, none):
    docs = spark.createDataFrame(made(300), "doc_id bigint, text string, source string")
    docs = docs.unionByName(docs.filter("doc_id < 40")).unionByName(docs.filter("doc_id < 30").selectExpr("null doc_id", "text", "source")).unionByName(odd.select("doc_id", "text", "source").filter("doc_id is null or doc_id not in (5, 6, 7)"))
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.sql("CREATE TABLE d2 AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents")
    c.unregister("documents")
    c.sql("CREATE VIEW documents AS SELECT * FROM d2")
    assert rows(lq.line_quality(docs).select(*NAMES)) == sorted(c.sql(lq.ORACLE).select(", ".join(NAMES)).fetchall(), key=repr)


def test_rows_of_every_kind(odd, none):
    out = lq.line_quality(odd)
    assert out.columns == NAMES and out.count() == odd.count() and lq.line_quality(none).count() == 0
    assert all(r.base_failed and not r.kept for r in out.filter("doc_id < 3").collect())
    assert out.filter("doc_id = 6").head().n_repeat_words == 30_000


def test_nothing_runs_in_python(odd):
    plan = lq.line_quality(odd.filter(F.lit(True)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_common_lines_leave_the_text(spark, odd, none):
    docs = [(i, f"own {i} first\n\nThe  MENU of this host\nown {i} last\nthe menu of this host", "hot") for i in range(20)] + [(20, "the menu of this host", "other"), (None, None, None)]
    out = {r.doc_id: tuple(r)[1:] for r in lq.cleaned(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert all(out[i] == (f"own {i} first\n\nown {i} last", 2, 45) for i in range(10)) and out[20] == ("the menu of this host", 0, 0)
    assert out[None] == ("", 0, 0) and lq.cleaned(odd).count() == odd.count() and lq.cleaned(none).count() == 0
