"""Classification metrics of scores ``p`` and labels ``y`` (0 or 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_thresholds(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Every row once for each threshold ``t``; a list of literals, so no join."""
    return df.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def confusion(df: DataFrame, by: Sequence[str] = ("t",)) -> DataFrame:
    """``tp, fp, fn, tn`` at p >= t."""
    on, pos = F.col("p") >= F.col("t"), F.col("y") == 1
    count = lambda c: F.count(F.when(c, 1))
    return df.groupBy(*by).agg(count(on & pos).alias("tp"), count(on & ~pos).alias("fp"), count(~on & pos).alias("fn"), count(~on & ~pos).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def threshold_counts(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts at many thresholds from one pass: rows are counted between thresholds, then summed up.

    The rows of the running sum are as many as thresholds, whatever the size of df.
    """
    grid = sorted({float(t) for t in thresholds})
    step = sum((F.when(F.col("p") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    bins = df.groupBy(step.alias("step")).agg(F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") != 1, 1)).alias("neg"))
    marks = df.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(grid)], "step int, t double").select("step", "t", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    every = marks.union(bins.select("step", F.lit(None).cast("double"), "pos", "neg")).groupBy("step").agg(F.max("t").alias("t"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above, whole = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = every.select("t", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    return sums.where("t IS NOT NULL").select("t", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def score_steps(df: DataFrame) -> DataFrame:
    """``p, pos, neg, tp, fp``: counts at each distinct score and running counts from the highest.

    Scores are summed by value first; the running sum goes over ranges of
    scores, then inside each, so no task sorts all of them.
    """
    # a range is told by the first bits of the score; those outside 0..1 are the first and the last range
    values = df.groupBy("p").agg(F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") != 1, 1)).alias("neg")).withColumn("part", F.least(F.greatest(F.floor(F.col("p") * 1024), F.lit(-1)), F.lit(1024)).cast("int"))
    sums = values.groupBy("part").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    before = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # some 1024 rows
    start = F.broadcast(sums.select("part", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0")))
    inside = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    return values.join(start, "part").select("p", "pos", "neg", (F.col("a0") + F.sum("pos").over(inside)).alias("tp"), (F.col("b0") + F.sum("neg").over(inside)).alias("fp"))


def average_precision(steps: DataFrame) -> Column:
    """Over ``score_steps``: the sum of precision times gained recall, ties as one step."""
    return F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")


def auroc(steps: DataFrame) -> Column:
    """Over ``score_steps``: the chance that a positive outranks a negative, ties half."""
    return F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, buckets: int = 1024) -> DataFrame:
    """``keys, name, value`` for ``wanted: keys, name, at``: the value at place ``at`` (from 0) of the ascending values of each group.

    Equal values are counted first, counts are summed by ranges between a
    group's extremes, and only a range that holds a wanted place is ordered; no
    task holds a group. NaN comes last.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    finite = F.when(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))), F.col("v"))
    ends = counts.groupBy(*keys).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    span = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets
    part = F.when(F.isnan("v"), buckets + 2).when(F.col("v") == float("inf"), buckets + 1).when(F.col("v") == float("-inf"), -1).when(F.col("hi") > F.col("lo"), F.least(F.floor(span), F.lit(buckets - 1))).otherwise(0)
    placed = counts.join(ends, list(keys)).select(*keys, "v", "c", part.cast("int").alias("part"))
    sums = placed.groupBy(*keys, "part").agg(F.sum("c").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # some 1024 rows a group
    held = sums.withColumn("start", before).join(wanted, list(keys)).where("at >= start AND at < start + c").select(*keys, "part", "name", (F.col("at") - F.col("start")).alias("at"))
    inside = F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    needed = placed.join(held.select(*keys, "part").distinct(), [*keys, "part"], "left_semi").withColumn("end", inside)
    return needed.join(held, [*keys, "part"]).where("at < end AND at >= end - c").select(*keys, "name", F.col("v").alias("value"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``keys, n`` and a column for each of ``qs``: linear quantiles of the non-null values of every group; without keys, of all."""
    if not keys:
        return quantiles(df.select(F.lit(0).alias("_all"), value), ["_all"], value, qs).drop("_all")
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    h = {name: (F.col("n") - 1) * F.lit(q) for name, q in qs.items()}
    places = [F.struct(F.lit(f"{name}:{end}").alias("name"), f(at).cast("long").alias("at")) for name, at in h.items() for end, f in (("a", F.floor), ("b", F.ceil))]
    wanted = n.select(*keys, F.explode(F.array(*places)).alias("w")).select(*keys, "w.*")
    found = order_statistics(df, keys, value, wanted).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == f"{name}:{end}", F.col("value"))).alias(f"{name}:{end}") for name in qs for end in "ab"])
    low, high = (lambda name, end=end: F.col(f"`{name}:{end}`") for end in "ab")
    mixed = [F.when(at == F.floor(at), low(name)).otherwise(low(name) + (high(name) - low(name)) * (at - F.floor(at))).alias(name) for name, at in h.items()]
    return n.join(found, list(keys)).select(*keys, "n", *mixed)
