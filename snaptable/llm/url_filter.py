"""URL filter: fixed rules first, else a path-template tree, in DataFrame functions only.

Per host the paths form a tree; its edges are segments, a folder's with a slash behind it, so that a page
and a folder of one name differ. Runs of digits in a segment are variable; a node's folders, or its pages,
that are nearly all different become one wildcard, level by level from the top, at any depth. The
rules' verdicts label the tree. Siblings in order of their blocked share merge as long as neighbours do not
differ by a two-proportion z test. A template's purity is its merged branch's share of blocked pages,
smoothed towards what its parent lets expect of a child: the mean share of the parent's labelled
children, smoothed in turn towards the same of the levels above, and towards one half at the top. So many labels in
one branch say little about a sibling, and without evidence nothing is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptable.llm.common import join_hot, named, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path prefix)
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

def host_and_path(frame: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host`` and ``path``: the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return frame.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null where none fits."""

    def fits(rule: str) -> Column:
        host, _, path = rule.partition("/")
        inside = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        return inside & F.col("path").startswith(f"/{path}")

    longest = sorted(rules, key=lambda r: -len(r[1]))
    name = F.coalesce(*[F.when(fits(r), F.lit(r)) for _, r in longest])
    verdict = F.coalesce(*[F.when(fits(r), F.lit(v)) for v, r in longest])
    return name, verdict


def labels_of(path: Column) -> Column:
    """The edges of a path from the top: segments with digits as ``{n}``, all but the last with a slash."""
    parts = F.array_remove(F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/"), "")
    last = F.size(parts) - 1
    edges = F.transform(parts, lambda s, i: F.when(i < last, F.concat(s, F.lit("/"))).otherwise(s))
    return F.when(F.size(parts) > 0, edges).otherwise(F.array(F.lit("")))


def templates(paths: DataFrame, least_children: int, rows_per_child: float) -> DataFrame:
    """``paths`` (host, labels, n and further columns) with ``template``, the labels with wildcards.

    One round for each level, over the paths below nodes that could still get a wildcard: a node of fewer than
    ``least_children`` paths has none below it, so long lone paths cost no rounds."""
    spark = paths.sparkSession
    open_, rounds, done = paths.withColumn("template", F.array().cast("array<string>")), [], []
    while True:
        k = len(rounds)
        # Below nodes with enough paths another level is looked at; all others are finished as they are.
        busy = open_.groupBy("host", "template").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least_children).drop("c")
        rest = F.concat("template", F.slice("labels", k + 1, 2**31 - 1))
        done.append(open_.join(busy, ["host", "template"], "left_anti").withColumn("template", rest).select(*paths.columns, "template"))
        going = open_.join(busy, ["host", "template"], "left_semi").withColumn("at", F.get("labels", F.lit(k)))
        going = going.withColumn("folder", F.col("at").endswith("/"))
        kinds = going.groupBy("host", "template", "folder", "at").agg(F.sum("n").alias("n")).groupBy("host", "template", "folder")
        wide = kinds.agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
        wide = wide.filter((F.col("kinds") >= least_children) & (F.col("all") < rows_per_child * F.col("kinds")))
        star = F.when(F.col("star"), F.when(F.col("folder"), F.lit("*/")).otherwise(F.lit("*"))).otherwise(F.col("at"))
        stepped = going.join(wide.select("host", "template", "folder", F.lit(True).alias("star")), ["host", "template", "folder"], "left")
        stepped = stepped.withColumn("template", F.concat("template", F.array(star))).select(*paths.columns, "template", "folder")
        level = written(spark, stepped, "level")
        if level.isEmpty():
            return written(spark, reduce(DataFrame.unionByName, done), "templates")
        rounds.append(level)
        done.append(level.filter(~F.col("folder")).drop("folder"))
        open_ = level.filter("folder").drop("folder")


def prefix(labels: str, size: Column | int) -> Column:
    return F.array_join(F.slice(labels, 1, size), "")


def purities(found: DataFrame, z_limit: float, prior: float) -> DataFrame:
    """(host, template, purity) for each template of ``found`` (host, template, labelled, blocked)."""
    spark = found.sparkSession
    known = found.filter("labelled > 0").groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    levels = F.sequence(F.lit(1), F.size("template"))
    nodes = known.select("host", "template", "l", "b", F.explode(levels).alias("d"))
    nodes = nodes.groupBy("host", prefix("template", F.col("d") - 1).alias("parent"), prefix("template", F.col("d")).alias("node")).agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    nodes = written(spark, nodes, "nodes")
    # Siblings with the same counts don't differ; so few rows are left of a parent with very many children.
    classes = nodes.groupBy("host", "parent", "l", "b").agg(F.count(F.lit(1)).alias("c"))
    along = Window.partitionBy("host", "parent").orderBy(F.col("b") / F.col("l"), "l")
    l0, b0 = F.lag("l").over(along), F.lag("b").over(along)
    pooled = (F.col("b") + F.col("b0")) / (F.col("l") + F.col("l0"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / F.col("l0")))
    z = (F.col("b") / F.col("l") - F.col("b0") / F.col("l0")) / F.when(error > 0, error)
    grouped = classes.withColumns({"l0": l0, "b0": b0}).withColumn("new", F.coalesce(z > z_limit, F.lit(False)).cast("int"))
    grouped = grouped.withColumn("branch", F.sum("new").over(along))
    whole = Window.partitionBy("host", "parent", "branch")
    merged = grouped.select(
        "host", "parent", "l", "b", "c", F.sum(F.col("l") * F.col("c")).over(whole).alias("gl"), F.sum(F.col("b") * F.col("c")).over(whole).alias("gb")
    )
    merged = written(spark, merged, "branches")
    share = F.sum(F.col("c") * (F.col("b") / F.col("l")))
    parents = merged.groupBy("host", "parent").agg(share.alias("share"), F.sum("c").alias("kinds"))
    each = found.select("host", "template").distinct()
    above = each.select("host", "template", F.explode(F.sequence(F.lit(0), F.size("template") - 1)).alias("d"))
    above = above.withColumn("parent", prefix("template", F.col("d"))).join(parents, ["host", "parent"])
    chain = above.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("d", "share", "kinds"))).alias("chain"))
    expected = F.aggregate("chain", F.lit(0.5), lambda m, x: (x["share"] + prior * m) / (x["kinds"] + prior))
    own = nodes.join(merged.drop("c"), ["host", "parent", "l", "b"]).select("host", "node", "gl", "gb")
    full = each.withColumn("node", F.array_join("template", "")).join(own, ["host", "node"], "left").join(chain, ["host", "template"], "left")
    hope = F.coalesce(expected, F.lit(0.5))
    purity = F.coalesce((F.col("gb") + prior * F.col("hope")) / (F.col("gl") + prior), F.col("hope"))
    return full.withColumn("hope", hope).select("host", "template", F.round(purity, 6).alias("purity"))


def url_filter(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    least_children: int = 20,
    rows_per_child: float = 2.0,
    z_limit: float = 1.96,
    prior: float = 2.0,
    reject_at: float = 0.8,
) -> DataFrame:
    """One row per row of ``pages``: identifier, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity``.

    The rules' verdicts are the tree's labels. A node's folders (or pages) become one wildcard if there
    are ``least_children`` or more of them with fewer than ``rows_per_child`` rows each on average. Sibling branches
    merge up to a z of ``z_limit``. Smoothing counts as ``prior`` pages, or children. A page without a rule is
    blocked if its template's purity is ``reject_at`` or more. Null URLs and URLs without ``://`` have empty host and path, ``/`` as
    template, and are one host; repeated rows stay, null identifiers too; an empty table gives no rows. Columns
    besides the two named are not read. Hosts are summed to their distinct typed paths first."""
    spark = pages.sparkSession
    name, verdict = rule_of(rules)
    rows = host_and_path(pages.select(named(id_col).alias("id"), named(url_col).cast("string").alias("url")), "url")
    rows = rows.select("id", "host", "path", name.alias("rule"), verdict.alias("ruled"), labels_of(F.col("path")).alias("labels"))
    paths = rows.groupBy("host", "labels").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ruled").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
    )
    found = templates(written(spark, paths, "paths"), least_children, rows_per_child)
    judged = found.select("host", "labels", "n", "template").join(purities(found, z_limit, prior), ["host", "template"])
    judged = judged.select("host", "labels", "n", F.concat(F.lit("/"), F.array_join("template", "")).alias("template"), "purity")
    leaf = written(spark, judged, "judged")
    total = leaf.agg(F.sum("n")).head()[0] or 0
    methods = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    return join_hot(rows, leaf, ["host", "labels"], "n", total, F.col("id")).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", methods).alias("verdict"), "template", "purity"
    )


ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
    list_filter(string_split(regexp_replace(path, '[0-9]+', '{n}', 'g'), '/'), lambda x: x <> '') AS s FROM p),
k AS (
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
    CASE WHEN len(s) = 0 THEN [''] ELSE list_transform(s, lambda x, i: CASE WHEN i < len(s) THEN x || '/' ELSE x END) END AS labels FROM r),
t AS (
  SELECT host, labels, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked FROM k GROUP BY ALL),
walk AS (
  SELECT host, labels, n, labelled, blocked, []::VARCHAR[] AS done, 0 AS d FROM t
  UNION ALL
  SELECT host, labels, n, labelled, blocked, list_append(done, CASE
      WHEN count(DISTINCT labels[d + 1]) OVER w < 20 OR sum(n) OVER w >= 2.0 * count(DISTINCT labels[d + 1]) OVER w THEN labels[d + 1]
      WHEN ends_with(labels[d + 1], '/') THEN '*/' ELSE '*' END), d + 1
  FROM walk WHERE d < len(labels) WINDOW w AS (PARTITION BY host, done, ends_with(labels[d + 1], '/'))),
f AS (SELECT host, labels, labelled, blocked, done AS tpl FROM walk WHERE d = len(labels)),
known AS (SELECT host, tpl, sum(labelled)::BIGINT AS l, sum(blocked)::BIGINT AS b FROM f WHERE labelled > 0 GROUP BY host, tpl),
nodes AS (
  SELECT host, array_to_string(tpl[1:d - 1], '') AS parent, array_to_string(tpl[1:d], '') AS node, sum(l)::BIGINT AS l, sum(b)::BIGINT AS b
  FROM (SELECT *, unnest(range(1, len(tpl) + 1)) AS d FROM known) GROUP BY ALL),
c AS (SELECT host, parent, l, b, count(*) AS c FROM nodes GROUP BY ALL),
c0 AS (SELECT *, lag(l) OVER w AS l0, lag(b) OVER w AS b0 FROM c WINDOW w AS (PARTITION BY host, parent ORDER BY b::DOUBLE / l, l)),
c1 AS (SELECT *, (b + b0)::DOUBLE / (l + l0) AS q FROM c0),
c2 AS (
  SELECT *, CASE WHEN q > 0 AND q < 1 AND (b::DOUBLE / l - b0::DOUBLE / l0) / sqrt(q * (1 - q) * (1.0::DOUBLE / l + 1.0::DOUBLE / l0)) > 1.96 THEN 1 ELSE 0 END AS new FROM c1),
c3 AS (SELECT *, sum(new) OVER (PARTITION BY host, parent ORDER BY b::DOUBLE / l, l) AS branch FROM c2),
m AS (
  SELECT host, parent, l, b, c, sum(l * c) OVER w AS gl, sum(b * c) OVER w AS gb FROM c3 WINDOW w AS (PARTITION BY host, parent, branch)),
par AS (SELECT host, parent, sum(c * (b::DOUBLE / l)) AS share, sum(c)::DOUBLE AS kinds FROM m GROUP BY host, parent),
e AS (SELECT DISTINCT host, tpl FROM f),
ch AS (
  SELECT e.host, e.tpl, list({'s': share, 'k': kinds} ORDER BY d) AS chain
  FROM (SELECT *, unnest(range(0, len(tpl))) AS d FROM e) e JOIN par ON par.host = e.host AND par.parent = array_to_string(e.tpl[1:d], '') GROUP BY e.host, e.tpl),
h AS (
  SELECT e.host, e.tpl, coalesce(list_reduce(list_prepend({'s': 0.5::DOUBLE, 'k': 0::DOUBLE}, chain),
    lambda a, x: {'s': (x.s + 2.0::DOUBLE * a.s) / (x.k + 2.0::DOUBLE), 'k': 0::DOUBLE}).s, 0.5::DOUBLE) AS hope
  FROM e LEFT JOIN ch ON e.host = ch.host AND e.tpl = ch.tpl),
j AS (
  SELECT h.host, h.tpl, round(coalesce((m.gb + 2.0::DOUBLE * hope) / (m.gl + 2.0::DOUBLE), hope), 6) AS purity
  FROM h LEFT JOIN nodes ON nodes.host = h.host AND nodes.node = array_to_string(h.tpl, '')
  LEFT JOIN m ON m.host = nodes.host AND m.parent = nodes.parent AND m.l = nodes.l AND m.b = nodes.b)
SELECT k.page_id, k.host, k.path, k.rule,
  coalesce(k.ruled, CASE WHEN j.purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(f.tpl, '') AS template, j.purity
FROM k JOIN f ON f.host = k.host AND f.labels = k.labels JOIN j ON j.host = f.host AND j.tpl = f.tpl
"""
