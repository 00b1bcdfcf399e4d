"""Splits, selections and repeats that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_rank(key: Column, seed: int = 0) -> Column:
    """A place in random order that other engines repeat: the digest of seed and key as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_share(key: Column, seed: int = 0) -> Column:
    """A number in 0..1, from the first 12 digits of ``hash_rank``."""
    return F.conv(F.substring(hash_rank(key, seed), 1, 12), 16, 10).cast("double") / F.lit(16.0**12)


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds ``split``: every key falls by its hash; no shuffle. Shares are met on the average; ``exact_split`` meets them."""
    x, edge, split = hash_share(F.col(key), seed), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        split = (F.when if split is None else split.when)(x < edge, name)
    return df.withColumn("split", split.otherwise(names[-1]) if split is not None else F.lit(names[-1]))


def exact_split(keys: DataFrame, key: str, fraction: float, seed: int = 0, digits: int = 3) -> DataFrame:
    """Adds ``held``: true for round-half-even(fraction * n) of the n distinct keys, those that come first in hashed order.

    Keys are counted by the first digits of their hashes; only the range in
    which the quota ends is ordered.
    """
    rows = keys.select(key).distinct().withColumn("_h", hash_rank(F.col(key), seed)).withColumn("_r", F.substring("_h", 1, digits))
    counts = rows.groupBy("_r").count()  # at most 16^digits rows
    before = F.coalesce(F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("count").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    quota = F.bround(whole * F.lit(fraction), 0).cast("long")
    cut = counts.select("_r", before.alias("_b"), (before + F.col("count")).alias("_e"), quota.alias("_q"))
    placed = rows.join(F.broadcast(cut), "_r")
    sure = placed.where("_e <= _q OR _b >= _q").select(key, (F.col("_e") <= F.col("_q")).alias("held"))
    last = placed.where("_e > _q AND _b < _q").withColumn("_n", F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)))
    return sure.union(last.select(key, (F.col("_n") <= F.col("_q")).alias("held")))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, those of the least hashes: a uniform sample without replacement that doesn't depend on order."""
    return df.orderBy(hash_rank(F.col(key), seed), key).limit(n)


def prioritised(df: DataFrame, pool: str, margin: str, key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by pool, margin and key, each key once."""
    once = df.groupBy(key).agg(F.min(F.struct(pool, margin)).alias("b")).select(key, F.col(f"b.{pool}").alias(pool), F.col(f"b.{margin}").alias(margin))
    return once.orderBy(pool, margin, key).limit(limit)


def repeat(df: DataFrame, times: Column) -> DataFrame:
    """Every row ``times`` times (at least once), numbered by ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), times))))


def leaking(df: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities in more than one split."""
    return df.where(F.col(entity).isNotNull() & F.col(split).isNotNull()).groupBy(entity).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def resolve_leaks(df: DataFrame, entity: str, split: str) -> DataFrame:
    """Adds ``new_split``: all rows of an entity go to its most frequent split (ties: the smallest); rows without an entity keep theirs."""
    votes = df.where(F.col(entity).isNotNull() & F.col(split).isNotNull()).groupBy(entity, split).count()
    best = votes.groupBy(entity).agg(F.max(F.struct("count", (-F.col(split)).alias("s"))).alias("b")).select(entity, (-F.col("b.s")).cast("int").alias("new_split"))
    return df.join(best, entity, "left").withColumn("new_split", F.coalesce("new_split", split))


def resplit_entities(df: DataFrame, entity: str, split: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds ``new_split``: of the entities, a ``fraction`` by hashed order is validation (1) and the rest training (0); rows without an entity keep their split."""
    held = exact_split(df.where(F.col(entity).isNotNull()), entity, fraction, seed)
    return df.join(held, entity, "left").withColumn("new_split", F.coalesce(F.col("held").cast("int"), F.col(split).cast("int"))).drop("held")


def first_row_split(df: DataFrame, group: str, order: str, split: str) -> DataFrame:
    """``group, split`` of the first row of every group, null where that row has none."""
    return df.groupBy(group).agg(F.min(F.struct(order, split)).alias("b")).select(group, F.col(f"b.{split}").alias(split))


def in_splits(df: DataFrame, group: str, order: str, split: str, wanted: list[int]) -> DataFrame:
    """Groups whose first row is of a wanted split; all groups where no group is."""
    first = first_row_split(df, group, order, split)
    asked = first.where(F.col(split).isin(wanted))
    none = asked.select(F.count("*") == 0).scalar()
    return first.where(none | F.coalesce(F.col(split).isin(wanted), F.lit(False)))


def running_fallback(df: DataFrame, keys: list[str], order: str, number: Column, width: int = 100_000) -> DataFrame:
    """Adds ``residue``: the number, or a count of the invalid ones so far in its group.

    order is an integer. Counts are summed by ranges of it first, so a large
    group isn't ordered by one task.
    """
    rows = df.withColumn("_bad", number.isNull().cast("int")).withColumn("_r", F.floor(F.col(order) / width))
    sums = rows.groupBy(*keys, "_r").agg(F.sum("_bad").alias("_s"))
    start = sums.select(*keys, "_r", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    w = Window.partitionBy(*keys, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(start, [*keys, "_r"]).withColumn("_n", F.col("_b") + F.sum("_bad").over(w))
    return joined.withColumn("residue", F.coalesce(number, F.col("_n").cast("int"))).drop("_bad", "_r", "_b", "_n")
