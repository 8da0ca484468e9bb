"""Mixing sources to token targets by entropy balancing, in DataFrame functions only.

Every document gets a rate. The rates of a source stay as near to 1 as possible (least relative
entropy, no rate above ``cap``) while the source's tokens come to its target. The dual of that
convex problem has one multiplier for each source: the rate is min(cap, exp(multiplier * size / mean
size)). Newton steps on all multipliers run as aggregations over the (source, size) histogram,
held inside a bracket. Rates then become whole copies by carrying the fractions along.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptable.llm.common import SPACE, counted, discard, fresh, named, text_of, written

BUCKET_ROWS = 512  # documents whose fractions are carried along together
BROADCAST_SOURCES = 50_000
SALTS = 64


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, f"{SPACE}+"), "")).cast("bigint")


def placed(sources: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``place``, the rank of each row in the order of its unique ``key``, from 0.

    Rows are dealt into ranges of keys and ranked there; what ranges before hold is a sum over one row for each range."""
    spark = sources.sparkSession
    ranged = written(spark, sources.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "ranges")
    # One row for each range, so at most as many as the session has shuffle partitions.
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"))
    before = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "range").withColumn("place", F.col("before") + F.col("inside")).drop("range", "inside", "before")


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (``key`` for the order, ``total`` tokens).

    Sources in order of ``key`` weigh ``weights``, repeating, and share ``share`` times all tokens. A
    target stops at ``cap`` times its source's tokens; the excess goes to the others by weight until
    none is above: round by round a sum over the sources gives the share of one unit of weight, which only grows."""
    spark = sources.sparkSession
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = placed(sources).withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("total")).drop("place")
    rows = written(spark, rows, "weighted")
    all_, count, every = rows.agg(F.sum("total"), F.count(F.lit(1)), F.sum("weight")).head()
    budget, stopped = float(share) * (all_ or 0), 0
    level = budget / every if count else 0.0
    while stopped < count:
        above = F.col("most") <= F.lit(level) * F.col("weight")
        n, spent, open_ = rows.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).head()
        if n <= stopped:
            break
        stopped = n
        level = (budget - spent) / open_ if open_ else level
    target = F.col("most") if stopped == count else F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return rows.withColumn("target", target).drop("most", "weight")


def multipliers(sized: DataFrame, cap: float = 2.0, tolerance: float = 1e-9, most_steps: int = 200) -> DataFrame:
    """One row per source: ``key``, ``total``, ``mean``, ``target``, and ``dual``, its multiplier.

    ``sized`` has (key, size, target) sums already in a histogram: key, size, n, total, docs, target. A source
    that has not converged after ``most_steps`` is an error; bisection alone needs about 100."""
    spark = sized.sparkSession
    top = log(cap)
    state = (
        sized.groupBy("key")
        .agg(F.first("total").alias("total"), F.first("target").alias("target"), F.first("mean").alias("mean"))
        .withColumns({"dual": F.lit(0.0), "low": F.col("mean") * -50.0, "high": F.col("mean") * top})
        .withColumn("gap", F.lit(None).cast("double"))
    )
    state = state_was = written(spark, state, "state")
    histogram = sized.select("key", "size", "n")
    for _ in range(most_steps):
        tilt = F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(top))
        tokens = F.col("n") * F.col("size") * F.exp(tilt)
        slope = F.when(F.col("dual") * F.col("size") / F.col("mean") < top, tokens * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = histogram.join(state, "key").groupBy("key").agg(F.sum(tokens).alias("now"), F.sum(slope).alias("slope"))
        gap = F.col("now") - F.col("target")
        low, high = F.when(gap < 0, F.col("dual")).otherwise(F.col("low")), F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        step = F.col("dual") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        moved = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = (F.abs(gap) <= tolerance * F.col("target")) | (F.col("target") >= cap * F.col("total")) | (F.col("target") <= 0)
        state = state.join(sums, "key").select(
            "key", "total", "target", "mean",
            F.when(done, F.col("dual")).otherwise(moved).alias("dual"),
            F.when(done, F.col("low")).otherwise(low).alias("low"),
            F.when(done, F.col("high")).otherwise(high).alias("high"),
            F.when(done | (high - low < 1e-12), F.lit(0.0)).otherwise(F.abs(gap)).alias("gap"),
        )
        last, state = state_was, written(spark, state, "state")
        discard(spark, last)
        state_was = state
        if not state.filter("gap > 0").head(1):
            break
    else:
        raise RuntimeError(f"the multipliers of some sources did not converge in {most_steps} steps")
    return state.select("key", "total", "mean", "target", F.round("dual", 9).alias("dual"))


def with_source(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Rows with their source's columns, so that a hot source is not dealt to one task.

    Up to BROADCAST_SOURCES sources are broadcast; more are joined on the source and a salt."""
    if count <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "key", "left")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "print", "number"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["key", "salt"], "left").drop("salt")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (``columns`` of them, default all) with a struct ``mix`` of size, source_size, target, rate, copies.

    Copies are whole and at most ``cap``. Within buckets of about BUCKET_ROWS documents of a source,
    from the longest to the shortest, the running sum of rates is rounded up from one fraction on, the
    same throughout the bucket: the one whose words come nearest to the bucket's. Rows without words have rate 1 and one copy. A null source is
    a source of its own, last in order; repeated rows are documents of their own, dealt to buckets like others; an empty table
    gives no rows. The same input gives the same copies. If ``docs`` has a column ``mix``, the struct is named ``mix_``."""
    spark = docs.sparkSession
    columns = list(docs.columns if columns is None else columns)
    (into,) = fresh(columns, "mix")
    key = F.coalesce(F.concat(F.lit("0"), named(source_col).cast("string")), F.lit("1"))  # null after all others
    whole = [named(c) for c in columns]
    base = docs.select(
        F.struct(*whole).alias("row"), key.alias("key"), n_words(text_of(text_col)).alias("size"),
        named(id_col).cast("string").alias("id"), F.xxhash64(text_of(text_col), *whole).alias("print"),
    )
    histogram = written(spark, base.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = histogram.groupBy("key").agg(
        F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("full")
    )
    aimed = written(spark, targets(sources, weights, share, cap), "targets")
    mean = F.col("total") / F.col("full")
    duals = multipliers(histogram.filter("size > 0").join(aimed.withColumn("mean", mean), "key"), cap)
    known = aimed.select("key", "total", "docs", "target").join(duals.select("key", "mean", "dual"), "key", "left")
    # Rows that are equal throughout are counted and dealt out again with numbers, so that they don't fill one bucket.
    who = ["key", "id", "print"]
    name = F.coalesce("id", F.lit("")).alias("id")
    again = base.select("key", name, "print").groupBy(*who).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = counted(written(spark, again, "again"))
    base = base.withColumn("id", name)
    equal = base.join(again, who, "left_semi").groupBy(*who, "size").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
    equal = equal.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    base = base.join(again, who, "left_anti").withColumn("number", F.lit(0)).unionByName(equal)
    rated = with_source(base, known, aimed.count())
    rate = (
        F.when((F.col("size") == 0), 1.0)
        .when(F.col("target") >= cap * F.col("total"), float(cap))
        .when(F.col("target") <= 0, 0.0)
        .otherwise(F.exp(F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(log(cap)))))
    )
    buckets = F.ceil(F.col("docs") / F.lit(BUCKET_ROWS))
    rated = rated.withColumn("rate", rate).withColumn("bucket", F.pmod(F.xxhash64("id", "print", "number"), buckets))
    along = Window.partitionBy("key", "bucket").orderBy(F.desc("size"), "id", "print", "number")
    # With the shortest last, a further copy at a place in the order moves one copy to it from the next.
    together = Window.partitionBy("key", "bucket")
    upto = F.round(F.sum("rate").over(along.rowsBetween(Window.unboundedPreceding, 0)), 9)
    steps = rated.withColumn("upto", upto).withColumn("step", F.col("size") - F.lead("size", 1, 0).over(along))
    steps = steps.withColumn("part", F.round(F.col("upto") - F.floor("upto"), 9)).withColumn("least", F.floor("upto"))
    missing = F.sum(F.col("rate") * F.col("size")).over(together) - F.sum(F.col("least") * F.col("step")).over(together)
    gained = F.sum("step").over(together.orderBy(F.desc("part")))  # with all places of that fraction or a larger one
    found = steps.withColumns({"missing": F.round(missing, 3), "gained": gained})
    nearest = F.min(F.struct(F.abs(F.col("missing") - F.col("gained")).alias("off"), F.col("part"))).over(together)
    least = F.when(nearest["off"] < F.abs("missing"), nearest["part"]).otherwise(2.0)
    found = found.withColumn("least", F.col("least") + (F.col("part") >= least).cast("bigint"))
    rounded = found.withColumn("copies", (F.col("least") - F.lag("least", 1, 0).over(along)).cast("bigint"))
    mixed = F.struct("size", F.col("total").alias("source_size"), "target", "rate", "copies").alias(into)
    return rounded.select(*[F.col("row").getField(c).alias(c) for c in columns], mixed)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as its copies say, with the columns of ``docs``, whatever their names.

    Rows without words stay once; nulls, repeated rows and empty tables are as in ``mix``."""
    taken = mix(docs, **how)
    copies = F.col(f"{taken.columns[-1]}.copies").cast("int")
    (turn,) = fresh(taken.columns, "turn")
    return taken.filter(copies > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), copies))).select(*[named(c) for c in docs.columns])
