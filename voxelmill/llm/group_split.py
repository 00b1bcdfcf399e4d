"""Splits that keep related records together.

Records that share a value of any key are joined by star edges to the smallest
record of that value. Borůvka rounds then contract them: every component picks
its least edge, the picked edges join the spanning forest, which is written
round by round, and components are renamed to the root they hang from. Roots
are dealt to the splits by size band.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from voxelmill.storage import materialize, release

GOLDEN = 0.6180339887498949


def star_edges(records: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """``a, b``: every record with the smallest record of each of its key values."""
    edges = []
    for key in keys:
        own = records.select(F.col(record).alias("b"), F.col(key).alias("key")).where("key IS NOT NULL AND b IS NOT NULL").distinct()
        centre = own.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        edges.append(own.join(centre, "key").where("a < b").select("a", "b"))
    return reduce(DataFrame.union, edges).distinct()


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns the forest (``round, a, b``) and the labels (``id, root``) of all ids with an edge.

    Each round at least halves the components that still have edges.
    """
    spark = edges.sparkSession
    live = materialize(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "a", "b").where("u < v"), "edges")
    labels = live.select(F.col("u").alias("id")).union(live.select("v")).distinct().select("id", F.col("id").alias("root"))
    forest, number = [], 0
    while not live.isEmpty():
        number += 1
        both = live.select("u", "v", "a", "b").union(live.select(F.col("v"), F.col("u"), "a", "b"))
        least = F.min(F.struct(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), F.col("a"), F.col("b")))
        pick = materialize(both.groupBy("u").agg(least.alias("e")).select("u", F.when(F.col("e.lo") == F.col("u"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("v"), "e.a", "e.b"), "pick")
        forest.append(materialize(pick.select(F.lit(number).alias("round"), "a", "b").distinct(), "forest"))
        # two components may pick the same edge: the smaller one is the root
        back = pick.select(F.col("u").alias("v"), F.col("v").alias("w"))
        up = materialize(pick.select("u", "v").join(back, "v").select("u", F.when((F.col("w") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p")), "up")
        release(pick)
        while True:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = materialize(up.join(above, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jump")
            release(up)
            up = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        old_labels, old_live = labels, live
        root = up.select(F.col("u").alias("root"), F.col("p").alias("r"))
        labels = materialize(labels.join(root, "root", "left").select("id", F.coalesce("r", "root").alias("root")), "labels")
        ends = live.join(up.select("u", F.col("p").alias("pu")), "u").join(up.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv")
        live = materialize(ends.groupBy(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).agg(F.min(F.struct("a", "b")).alias("e")).select("u", "v", "e.a", "e.b"), "edges")
        release(up)
        release(old_live)
        if number > 1:
            release(old_labels)
    trees = reduce(DataFrame.union, forest) if forest else spark.createDataFrame([], f"round int, a {dict(edges.dtypes)['a']}, b {dict(edges.dtypes)['b']}")
    return trees, labels


def related_groups(records: DataFrame, record: str, keys: list[str], kept: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``id, group_no, size`` of every record, and the spanning forest ``round, a, b`` of the groups.

    Records that share a key, also through others, form a group named after its
    smallest record. Null keys relate nothing. Repeated rows count once; a
    record may have rows with different keys, which all count. A record without
    related ones is a group of its own; rows with a null record are left out.
    The forest has one edge less than a group has records, and tells why they
    lie together. It is written round by round; ``kept`` names a folder where
    it stays after the session.
    """
    forest, labels = spanning_forest(star_edges(records, record, keys))
    if kept:
        forest.write.mode("overwrite").parquet(kept)
        forest = records.sparkSession.read.schema(forest.schema).parquet(kept)
    ids = records.select(F.col(record).alias("id")).where("id IS NOT NULL").distinct()
    rooted = materialize(ids.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("id").alias("group_no"), F.count("*").alias("size"))
    return rooted.join(names, "root").select("id", "group_no", "size"), forest


def deal_groups(groups: DataFrame, shares: dict[str, float], large: int = 1000, buckets: int = 256, seed: int = 7) -> DataFrame:
    """``group_no, size, split`` for groups ``group_no, size``.

    Groups that hold at least one in ``large`` of all records, of which there
    are at most ``large``, go one by one to the split that is furthest behind
    its share. All others are dealt systematically: within a size band (powers
    of two, largest first) in hashed order, with a golden-ratio step through
    what the shares still lack.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("size")).first()[0] or 0
    whole = sum(shares.values())
    lack = {name: total * share / whole for name, share in shares.items()}
    heavy = F.col("size") * large >= F.lit(total)
    dealt = []
    for g in groups.where(heavy).orderBy(F.desc("size"), "group_no").collect():
        name = max(lack, key=lambda k: (lack[k] / shares[k] if shares[k] else float("-inf"), lack[k]))
        lack[name] -= g["size"]
        dealt.append((g["group_no"], g["size"], name))
    kind = f"group_no {dict(groups.dtypes)['group_no']}, size long, split string"
    out = spark.createDataFrame(dealt, kind)
    rest = {name: max(x, 0.0) for name, x in lack.items()}
    missing = sum(rest.values()) or 1.0
    h = F.xxhash64("group_no", F.lit(seed))
    light = groups.where(~heavy).select("group_no", "size", F.floor(F.log2("size")).cast("int").alias("band"), h.alias("h"), F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"))
    counts = light.groupBy("band", "bucket").agg(F.count("*").alias("n"))  # at most 64 bands times the buckets
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("band"), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.broadcast(counts.select("band", "bucket", before.alias("start")))
    place = F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "group_no"))
    x = F.pmod((F.col("start") + place) * F.lit(GOLDEN), F.lit(1.0))
    light = light.join(start, ["band", "bucket"]).withColumn("x", x)
    split, edge = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        edge += rest[name] / missing
        split = (F.when if split is None else split.when)(F.col("x") < edge, name)
    split = split.otherwise(names[-1]) if split is not None else F.lit(names[-1])
    return out.union(light.select("group_no", F.col("size").cast("long"), split.alias("split")))
