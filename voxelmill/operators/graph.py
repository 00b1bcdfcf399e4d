"""Components, density clusters and greedy selections."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelmill.operators import kernels
from voxelmill.operators.grouped import map_groups
from voxelmill.operators.spatial import AXES, radius_pairs
from voxelmill.storage import materialize, release

#: Points of a group up to which one task clusters it.
WHOLE = 50_000
LISTED = 10_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of all nodes of ``a, b``; component is its smallest node.

    Large-star and small-star rounds alternate; hubs lose their edges in the
    first rounds, so no node keeps an unbounded neighbourhood.
    """
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    live = pairs.where("u <> v")
    while True:
        both = live.union(live.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small_least.select("u", F.col("m").alias("v")).where("u <> v"))
        star = materialize(small.distinct(), "star")
        same = star.join(live, ["u", "v"], "left_anti").isEmpty() and live.join(star, ["u", "v"], "left_anti").isEmpty()
        live = star
        if same:
            break
    return nodes.join(live.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _component_kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Components of the edges of many groups at once; nodes of different groups are different."""
    edges = np.stack([table.column("a").to_numpy(), table.column("b").to_numpy()], 1)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    both = np.stack([np.repeat(group, 2), edges.ravel()], 1)
    nodes, at = np.unique(both, axis=0, return_inverse=True)
    at = at.reshape(-1, 2)
    root = kernels.components(len(nodes), at[:, 0], at[:, 1])
    g = table.column("g").take(pa.array(starts[:-1])).take(pa.array(nodes[:, 0]))
    return pa.table({"g": g, "id": nodes[:, 1], "component": nodes[root, 1]})


def group_components(edges: DataFrame, group: str, whole: int = 1_000_000, keep_group: bool = False) -> DataFrame:
    """``id, component`` for edges ``a, b`` that never leave their group; with ``keep_group``, where ids of different groups may be equal, with the group.

    Groups of over ``whole`` edges are contracted as a table.
    """
    rows = materialize(edges.select(F.col(group).alias("g"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    sizes = rows.groupBy("g").count().where(F.col("count") > whole).select("g")
    kind = f"g {dict(rows.dtypes)['g']}, id long, component long"
    out = lambda df: df.select(*([F.col("g").alias(group)] if keep_group else []), "id", "component")
    if sizes.isEmpty():
        return out(map_groups(rows, ["g"], _component_kernel, kind))
    small = map_groups(rows.join(sizes, "g", "left_anti"), ["g"], _component_kernel, kind)
    big = rows.join(sizes, "g", "left_semi").select(F.struct("g", F.col("a").alias("i")).alias("a"), F.struct("g", F.col("b").alias("i")).alias("b"))
    return out(small).union(out(connected_components(big).select("id.g", F.col("id.i").alias("id"), F.col("component.i").alias("component"))))


def _cluster_kernel(radius: float, least: int, table: pa.Table, starts: np.ndarray) -> pa.Table | None:
    ids = table.column("i").to_numpy()
    x = np.stack([table.column(a).to_numpy() for a in AXES], 1)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    i, j, _ = kernels.radius_pairs(x, group, radius)
    n = len(ids)
    core = np.bincount(i, minlength=n) + np.bincount(j, minlength=n) + 1 >= least
    inner = core[i] & core[j]
    root = kernels.components(n, i[inner], j[inner])
    name = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(name, root[core], ids[core])
    cluster = np.where(core, name[root], np.iinfo(np.int64).max)
    for a, b in ((i, j), (j, i)):  # a border point goes to the least cluster in reach
        edge = core[a] & ~core[b]
        np.minimum.at(cluster, b[edge], name[root[a[edge]]])
    keep = np.flatnonzero(cluster < np.iinfo(np.int64).max)
    if not len(keep):
        return None
    return pa.table({"g": table.column("g").take(pa.array(keep)), "i": ids[keep], "cluster_id": cluster[keep]})


def density_clusters(points: DataFrame, group: str, item: str, radius: float, min_samples: int = 1, min_size: int = 1, whole: int = WHOLE) -> DataFrame:
    """``group, item, cluster_id``: DBSCAN; with ``min_samples`` 1, single linkage.

    A core point has ``min_samples`` points within ``radius``, itself counted.
    Noise and clusters of fewer than ``min_size`` points are left out.
    cluster_id is the smallest id of the cluster's core points. Groups of over
    ``whole`` points are clustered as an edge table instead of by one task.
    """
    rows = points.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i"), *AXES)
    kind = f"g {dict(rows.dtypes)['g']}, i long, cluster_id long"
    sizes = rows.groupBy("g").count().where(F.col("count") > whole).select("g")
    large = [r["g"] for r in sizes.limit(LISTED + 1).collect()]
    if large:
        big_groups = F.broadcast(points.sparkSession.createDataFrame([(g,) for g in large], f"g {dict(rows.dtypes)['g']}")) if len(large) <= LISTED else sizes
        out = map_groups(rows.join(big_groups, "g", "left_anti"), ["g"], partial(_cluster_kernel, radius, min_samples), kind).union(_by_edges(rows.join(big_groups, "g", "left_semi"), radius, min_samples))
    else:
        out = map_groups(rows, ["g"], partial(_cluster_kernel, radius, min_samples), kind)
    if min_size > 1:
        out = materialize(out, "clusters")
        out = out.join(out.groupBy("g", "cluster_id").count().where(F.col("count") >= min_size).drop("count"), ["g", "cluster_id"], "left_semi")
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "cluster_id")


def _by_edges(rows: DataFrame, radius: float, min_samples: int) -> DataFrame:
    pairs = materialize(radius_pairs(rows, "g", "i", radius).select("a", "b"), "pairs")
    both = pairs.union(pairs.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    core = materialize(rows.join(degree, rows["i"] == degree["a"], "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("g", "i"), "core")
    ends = core.select("i")
    inner = pairs.join(ends.withColumnRenamed("i", "a"), "a", "left_semi").join(ends.withColumnRenamed("i", "b"), "b", "left_semi")
    label = connected_components(inner).select(F.col("id").alias("i"), "component")
    named = materialize(core.join(label, "i", "left").select("g", "i", F.coalesce("component", "i").alias("cluster_id")), "named")
    border = both.join(named.select(F.col("i").alias("a"), "cluster_id"), "a").join(ends.withColumnRenamed("i", "b"), "b", "left_anti").groupBy("b").agg(F.min("cluster_id").alias("cluster_id"))
    return named.union(border.join(rows.select("g", F.col("i").alias("b")), "b").select("g", F.col("b").alias("i"), "cluster_id"))


def greedy_suppression(items: DataFrame, item: str, order: list[Column], edges: DataFrame) -> DataFrame:
    """``item`` kept by greedy suppression: in order, an item is kept unless a kept one is its neighbour (``a, b`` of edges).

    Done in rounds: an open item that comes before all its open neighbours is
    kept, and its neighbours are dropped. The outcome is that of the sequence.
    """
    key = F.struct(*order, F.col(item))
    ranked = items.select(F.col(item).alias("i"), key.alias("k"))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    links = materialize(both.join(ranked.select(F.col("i").alias("a"), F.col("k").alias("ka")), "a").join(ranked.select(F.col("i").alias("b"), F.col("k").alias("kb")), "b").select("a", "b", (F.col("kb") < F.col("ka")).alias("later")), "links")
    kept = [materialize(items.select(F.col(item).alias("i")).join(links.select(F.col("a").alias("i")), "i", "left_anti"), "kept")]
    while not links.isEmpty():
        first = materialize(links.groupBy("a").agg(F.max("later").alias("waits")).where("NOT waits").select(F.col("a").alias("i")), "kept")
        kept.append(first)
        dropped = links.join(first.select(F.col("i").alias("a")), "a", "left_semi").select(F.col("b").alias("i")).distinct()
        gone = materialize(first.union(dropped), "gone")
        rest = links.join(gone.select(F.col("i").alias("a")), "a", "left_anti").join(gone.select(F.col("i").alias("b")), "b", "left_anti")
        # an item without open neighbours left is kept
        open_now = links.join(gone.select(F.col("i").alias("a")), "a", "left_anti").select("a").distinct()
        rest = materialize(rest, "links")
        kept.append(materialize(open_now.join(rest.select("a"), "a", "left_anti").select(F.col("a").alias("i")), "kept"))
        release(links)
        links = rest
    return reduce(DataFrame.union, kept).select(F.col("i").alias(item))


def greedy_match(pairs: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """The pairs that greedy matching takes: in order, a pair whose ends are both free.

    Done in rounds: a pair that comes first at both its ends is taken, and all
    pairs of its ends are dropped.
    """
    live = materialize(pairs.withColumn("_k", F.struct(*order, F.col(left), F.col(right))), "pairs")
    taken = []
    while not live.isEmpty():
        best_l = live.groupBy(left).agg(F.min("_k").alias("_l"))
        best_r = live.groupBy(right).agg(F.min("_k").alias("_r"))
        both = live.join(best_l, left).join(best_r, right).where((F.col("_k") == F.col("_l")) & (F.col("_k") == F.col("_r")))
        now = materialize(both.select(*live.columns), "taken")
        taken.append(now.drop("_k"))
        rest = materialize(live.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti").select(*live.columns), "pairs")
        release(live)
        live = rest
    return reduce(DataFrame.unionByName, taken) if taken else pairs.limit(0)


def knn_graph(neighbours: DataFrame, group: str, a: str, b: str, radius: float) -> DataFrame:
    """Symmetric edges of a neighbour table (``d2``) cut at ``radius``, self-loops left out: either direction makes an edge."""
    near = neighbours.where((F.col("d2") <= radius * radius) & (F.col(a) != F.col(b))).select(group, F.col(a).alias("a"), F.col(b).alias("b"))
    return near.union(near.select(group, F.col("b"), F.col("a"))).distinct()


def smooth(nodes: DataFrame, item: str, value: str, edges: DataFrame, alpha: float = 0.7, rounds: int = 1, isolated: str = "keep") -> DataFrame:
    """``item, value`` after value <- alpha * value + (1 - alpha) * mean of neighbours, ``rounds`` times. isolated: ``keep`` the value, or ``shrink`` it by alpha."""
    if isolated not in ("keep", "shrink"):
        raise ValueError("isolated must be keep or shrink")
    now = nodes.select(F.col(item).alias("i"), F.col(value).alias("v"))
    for k in range(rounds):
        around = edges.select(F.col("a").alias("i"), F.col("b").alias("o")).join(now.select(F.col("i").alias("o"), F.col("v").alias("w")), "o").groupBy("i").agg(F.avg("w").alias("w"))
        alone = F.col("v") if isolated == "keep" else alpha * F.col("v")
        now = now.join(around, "i", "left").select("i", F.when(F.col("w").isNull(), alone).otherwise(alpha * F.col("v") + (1 - alpha) * F.col("w")).alias("v"))
        if k + 1 < rounds:
            now = materialize(now, "smooth")
    return now.select(F.col("i").alias(item), F.col("v").alias(value))


def hull_volumes(points: DataFrame, group: str, cluster: str) -> DataFrame:
    """``group, cluster, volume`` of convex hulls; null under four points or where flat. Clusters are bounded sets of points."""

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x = np.stack([table.column(a).to_numpy() for a in AXES], 1)
        first = pa.array(starts[:-1])
        return pa.table({group: table.column(group).take(first), cluster: table.column(cluster).take(first), "volume": pa.array([kernels.hull_volume(x[s:e]) for s, e in zip(starts[:-1], starts[1:])], pa.float64())})

    kinds = dict(points.dtypes)
    return map_groups(points.select(group, cluster, *AXES), [group, cluster], kernel, f"`{group}` {kinds[group]}, `{cluster}` {kinds[cluster]}, volume double")


def place(df: DataFrame, group: str | list[str], *order: Column | str) -> DataFrame:
    """Adds ``rank``, 1 first, inside each group."""
    keys = [group] if isinstance(group, str) else group
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
