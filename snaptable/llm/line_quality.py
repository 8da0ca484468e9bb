"""Quality rules with cross-document line frequency, in DataFrame functions only.

A first pass over the texts gives each document's own counts and the hashes of its distinct
normalised lines. Lines are then counted over distinct documents per host, lines above the
host's limit are removed, and documents that lose too much of their characters are rejected.
Rows of one identifier are one document; a row without an identifier is known by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptable.llm.common import SPACE, counted, join_hot, let, named, text_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def covered(hashes: Column, window: int) -> Column:
    """Words inside windows whose hash occurs twice or more; ``hashes`` are a text's windows in order."""

    def positions(ordered: Column) -> Column:
        def repeated(s: Column, j: Column) -> Column:
            before = (j > 0) & (F.get(ordered, j - 1)["h"] == s["h"])
            return F.when(before | F.coalesce(F.get(ordered, j + 1)["h"] == s["h"], F.lit(False)), s["i"])

        return F.array_sort(F.filter(F.transform(ordered, repeated), lambda i: i.isNotNull()))

    def total(found: Column) -> Column:
        steps = F.transform(found, lambda i, j: F.least(F.lit(window), F.coalesce(F.get(found, j + 1) - i, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(paired, positions), total)


def normal(line: Column) -> Column:
    """The hash and the characters of a line without regard to white space and ASCII case."""
    clean = F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), f"{SPACE}+", " "))
    return let(clean, lambda c: F.struct(F.xxhash64(c).alias("line"), F.char_length(c).cast("bigint").alias("chars")))


def own_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str, window: int = 8) -> DataFrame:
    """One row per document: what its text alone shows, and its distinct normalised lines (hash, characters)."""
    text = docs.select(named(id_col).alias("id"), named(host_col).cast("string").alias("host"), text_of(text_col).alias("text"))
    parts = text.select(
        "id",
        F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host"),  # a null host is a host of its own
        "text",
        F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    hashed = parts.select(
        "id",
        "host",
        F.xxhash64("text").alias("print"),
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.translate("text", "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("words") >= window, let(F.transform("words", lambda w: F.xxhash64(w)), windows))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
        F.array_distinct(F.transform("lines", normal)).alias("lines"),
    )
    once = F.size(F.array_distinct("windows")) == F.size("windows")
    return hashed.select(
        "id", "host", "print", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(once, F.lit(0)).otherwise(covered(F.col("windows"), window)).cast("bigint").alias("n_repeat_words"),
        "lines",
    )


def above_limit(found: DataFrame, least_docs: int, most_share: float, most_docs: int) -> DataFrame:
    """(host, line, n, gone), written: the lines above their host's limit, with the number of documents that have them.

    ``found`` has id, host, print (of the text) and lines, the distinct ones of a row. Only the lines of identifiers
    that occur more than once are made distinct; all others are distinct as they are."""
    spark = found.sparkSession
    rows = found.select("host", F.col("id").cast("string").alias("name"), F.when(F.col("id").isNull(), F.col("print")).otherwise(0).alias("print"), "lines.line")
    rows = rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "name"), F.lit("")))
    who = ["host", "name", "print"]
    documents = written(spark, rows.groupBy(*who).agg(F.count(F.lit(1)).alias("rows")), "documents")
    again = counted(documents.filter("rows > 1").select(*who))
    once = rows.join(again, who, "left_anti").select("host", F.explode("line").alias("line"))
    more = rows.join(again, who, "left_semi").select(*who, F.explode("line").alias("line")).distinct().select("host", "line")
    common = once.unionByName(more).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least_docs)
    hosts = documents.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    limit = F.least(F.greatest(F.lit(float(least_docs)), most_share * F.col("docs")), F.lit(float(most_docs)))
    above = common.join(hosts, "host").filter(F.col("n") > limit)
    return written(spark, above.select("host", "line", "n", F.lit(True).alias("gone")), "above")


def removed(found: DataFrame, above: DataFrame, *sums) -> DataFrame:
    """(x, y, z) for id, host, print of the rows that have lines above the limit, and ``sums`` over those (line, chars), each once."""
    lines = found.select("id", "host", "print", F.explode("lines").alias("x")).select("id", "host", "print", "x.line", "x.chars")
    total = found.agg(F.sum(F.size("lines"))).head()[0] or 0
    hits = join_hot(lines, above, ["host", "line"], "n", total, F.struct("id", "print"), "inner")
    each = hits.groupBy("id", "host", "print", "line").agg(F.first("chars").alias("chars"))
    return each.groupBy(F.col("id").alias("x"), F.col("host").alias("y"), F.col("print").alias("z")).agg(*sums)


def cleaned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least_docs: int = 10,
    most_share: float = 0.005,
    most_docs: int = 1000,
) -> DataFrame:
    """One row per row of ``docs``: the identifier, the text without the lines above their host's limit,
    ``n_removed_lines`` and ``removed_chars`` (line ends included). Limits are those of ``line_quality``; all
    occurrences go, other lines stay as they are. A null text is empty; repeated rows are cleaned alike; an
    empty table gives no rows; other columns are not read."""
    host = F.coalesce(F.concat(F.lit("="), named(host_col).cast("string")), F.lit(""))
    rows = docs.select(named(id_col).alias("id"), host.alias("host"), text_of(text_col).alias("text")).withColumn("print", F.xxhash64("text"))
    split = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = written(docs.sparkSession, rows.select("id", "host", "print", F.array_distinct(F.transform(split, normal)).alias("lines")), "lines")
    gone = removed(found, above_limit(found, least_docs, most_share, most_docs), F.collect_set("line").alias("gone"))
    same = rows["id"].eqNullSafe(gone["x"]) & (rows["host"] == gone["y"]) & (rows["print"] == gone["z"])
    whole = F.split("text", "\n")
    left = F.when(F.col("gone").isNull(), whole).otherwise(F.filter(whole, lambda x: ~F.array_contains("gone", normal(x)["line"])))
    kept = rows.join(gone, same, "left").withColumn("left", left)
    clean = F.array_join("left", "\n")
    return kept.select(
        F.col("id").alias(id_col), clean.alias(text_col),
        (F.size(whole) - F.size("left")).cast("bigint").alias("n_removed_lines"),
        (F.char_length("text") - F.char_length(clean)).cast("bigint").alias("removed_chars"),
    )


def line_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least_docs: int = 10,
    most_share: float = 0.005,
    most_docs: int = 1000,
    least_kept: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: the identifier, the text's own counts, ``base_failed``, ``kept``,
    ``n_common_lines`` and ``common_chars``.

    A line is above its host's limit if more than max(least_docs, most_share * documents of the
    host), or more than ``most_docs``, documents have it; the last two columns count a row's distinct normalised lines
    above it and their characters. A document is depleted if less than ``least_kept`` of the characters
    of its distinct normalised lines remains. A null text is empty and fails the base rule; a null
    host is a host of its own; rows that repeat an identifier are one document to the limits, and each gets
    its row; an empty table gives no rows. Only the three named columns are read."""
    spark = docs.sparkSession
    found = written(spark, own_counts(docs, id_col, text_col, host_col), "own")
    gone = removed(
        found, above_limit(found, least_docs, most_share, most_docs), F.count(F.lit(1)).alias("common"), F.sum("chars").alias("common_chars")
    )
    same = found["id"].eqNullSafe(gone["x"]) & (found["host"] == gone["y"]) & (found["print"] == gone["z"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["chars"])
    lost = F.coalesce("common_chars", F.lit(0))
    return found.join(gone, same, "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (total - lost >= least_kept * total)).alias("kept"),
        F.coalesce("common", F.lit(0)).cast("bigint").alias("n_common_lines"),
        lost.cast("bigint").alias("common_chars"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
    coalesce('=' || doc_id, ':' || coalesce(text, '')) AS name FROM documents),
w AS (
  SELECT rid, doc_id, host, t, name,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c >= 2),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM twice GROUP BY rid),
ln AS (
  SELECT DISTINCT rid, host, name, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT rid, host, name, unnest(l) AS x FROM w)),
hosts AS (SELECT host, count(DISTINCT name) AS docs FROM d GROUP BY host),
above AS (
  SELECT c.host, c.line FROM (SELECT host, line, count(DISTINCT name) AS n FROM ln GROUP BY host, line) c
  JOIN hosts USING (host) WHERE c.n > least(greatest(10, 0.005::DOUBLE * docs), 1000)),
sums AS (
  SELECT ln.rid, sum(length(ln.line)) AS total, count(above.line) AS common, sum(CASE WHEN above.line IS NULL THEN 0 ELSE length(ln.line) END) AS lost
  FROM ln LEFT JOIN above ON ln.host = above.host AND ln.line = above.line GROUP BY ln.rid),
own AS (
  SELECT w.rid AS rid, doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(total - lost < 0.5 * total, false) AS kept,
  coalesce(common, 0)::BIGINT AS n_common_lines, coalesce(lost, 0)::BIGINT AS common_chars
FROM own LEFT JOIN sums ON own.rid = sums.rid
"""
