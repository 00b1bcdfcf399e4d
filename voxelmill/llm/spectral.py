"""Similarity clusters by power-iteration spectral clustering.

Members of a group are joined by affinities exp(-d^2 / 2 r^2) wherever they lie
within a radius r. The random-walk matrix of the affinities is applied to
several random vectors until they no longer differ along any affinity; they are
then constant on every cluster and, having random starts, differ between
clusters. k-means on the embedding, with Lloyd rounds from seeds at its gaps,
gives the clusters, and members are ranked by their affinity to their own
cluster. The polynomial of the walk is Chebyshev's, so long thin clusters need
a number of steps in proportion to their length instead of its square.

An affinity never leaves its group, so a task iterates the blocks of many
groups at once and no step needs a shuffle. Groups beyond a size are cut into
tiles that overlap by the radius. Clusters of tiles that share members are the
nodes of a second affinity graph, which is clustered in the same way in blocks
of tiles that grow from level to level.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxelmill.operators.grouped import map_groups
from voxelmill.operators.kernels import PAIRS, number, radius_pair_blocks
from voxelmill.storage import materialize, release

VECTORS = 4
SAME = 1e-8  # entries joined by an affinity differ by less once iterated
GAP = 1e-6  # those of one cluster too, those of two by far more in some vector
TILE = ("tx", "ty", "tz")
WHOLE = 50_000  # members of a group beyond which it is cut into tiles


def embed(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, seed: int = 5) -> np.ndarray:
    """``VECTORS`` vectors, iterated until they agree along every affinity.

    One pass of m steps applies T_m(M) / T_m(1 / (1 - gap)), M the lazy walk
    mapped so that everything below 1 - gap falls into -1..1. Blocks with a
    smaller gap than assumed stay unsettled and go on with a quarter of it.
    """
    v = np.random.default_rng(seed).random((n, VECTORS))
    src, dst, ww = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
    order = np.argsort(src, kind="stable")
    src, dst, ww = src[order], dst[order], ww[order]
    degree = np.bincount(src, ww, n) + 1.0
    gap = 0.05
    live = np.flatnonzero(np.bincount(src, minlength=n) > 0)
    while len(live):
        # the unsettled members, renumbered; whole clusters are live or not
        new = np.full(n, -1)
        new[live] = np.arange(len(live))
        own = new[src] >= 0
        s, d, x = new[src[own]], new[dst[own]], ww[own]
        starts = np.searchsorted(s, np.arange(len(live)))
        deg = degree[live][:, None]

        def walk(y: np.ndarray) -> np.ndarray:
            return (y + (np.add.reduceat(x[:, None] * y[d], starts, axis=0) + y) / deg) / 2

        steps = int(np.ceil(13 / np.sqrt(gap)))
        z = 1 - gap
        before, now = v[live], None
        at, t0, t1 = 2 / z - 1, 1.0, 2 / z - 1  # T_0 and T_1 at the eigenvalue 1 of the walk
        now = (2 * walk(before) / z - before) / at
        for _ in range(steps - 1):
            t2 = 2 * at * t1 - t0
            after = (2 * (2 * walk(now) / z - now) * t1 - before * t0) / t2
            before, now, t0, t1 = now, after, t1, t2
            if t1 > 1e100:
                t0, t1 = t0 / t1, 1.0
        v[live] = now
        apart = np.abs(now[s] - now[d]).max(1)
        # a block is settled if it would not move: judged by its affinities, for all blocks that hold none apart
        restless = np.zeros(len(live), bool)
        restless[s[apart > SAME * gap]] = True
        while True:  # a cluster goes on as a whole
            grown = restless.copy()
            grown[s[restless[d]]] = True
            if (grown == restless).all():
                break
            restless = grown
        live, gap = live[restless], gap / 4
        if gap < 1e-14:
            raise ArithmeticError("the walk does not settle")
    return v


def seeds(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """First clusters: runs of the embedding of a group without a gap in any of its vectors, which are sorted in turn until nothing splits."""
    label = np.unique(group, return_inverse=True)[1].astype(np.int64)
    found = 0
    while label.max(initial=-1) + 1 > found:
        found = label.max() + 1
        for c in range(v.shape[1]):
            order = np.lexsort((v[:, c], label))
            new = np.ones(len(v), bool)
            new[1:] = (label[order][1:] != label[order][:-1]) | (np.diff(v[order, c]) > GAP)
            label[order] = np.cumsum(new) - 1
    return label


def k_means(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Cluster numbers: Lloyd rounds from ``seeds`` until no member changes to another centre of its group.

    Only centres whose first entry differs from a member's by no more than the
    distance to its present centre can be nearer, so few are looked at.
    """
    label = seeds(v, group)
    while True:
        label = np.unique(label, return_inverse=True)[1]
        count = np.bincount(label)
        centre = np.stack([np.bincount(label, v[:, c]) / count for c in range(v.shape[1])], 1)
        owner = np.zeros(len(count), np.int64)
        owner[label] = group
        step = float(np.ptp(v[:, 0])) + 4 if len(v) else 4.0
        key = owner * step + centre[:, 0]
        order = np.argsort(key, kind="stable")
        reach = np.sqrt(((v - centre[label]) ** 2).sum(1)) + 1e-9
        at = group * step + v[:, 0]
        low, high = np.searchsorted(key[order], at - reach), np.searchsorted(key[order], at + reach, "right")
        n = high - low
        begin = np.cumsum(n) - n
        who = np.repeat(np.arange(len(v)), n)
        which = order[np.arange(len(who)) - begin[who] + low[who]]
        d2 = ((v[who] - centre[which]) ** 2).sum(1)
        best = np.lexsort((which != label[who], d2, who))[begin]  # of equals the present one
        new = which[best] if len(v) else label
        if (new == label).all():
            return label
        label = new


def cluster(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Cluster numbers of n nodes with affinities. An affinity that leaves its cluster, or two clusters in one place of the embedding, call for other start vectors."""
    for seed in (5, 6, 7):
        v = embed(n, i, j, w, seed)
        label = k_means(v, group)
        low = np.full((label.max(initial=-1) + 1, VECTORS), np.inf)
        high = -low
        np.minimum.at(low, label, v)
        np.maximum.at(high, label, v)
        if not (label[i] != label[j]).any() and (high - low).max(initial=0) <= GAP:
            return label
    raise ArithmeticError("the embedding does not tell the clusters apart")


def affinities(x: np.ndarray, group: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members as nodes: node of each member; affinities ``i, j, w`` of nodes; and each member's sum of affinities.

    Members that share a cell of side radius / sqrt(3) all lie within the radius
    of each other, so they are one node; two nodes are joined by the strongest
    affinity of their members. Pairs are formed in blocks and never held, so a
    crowd within one radius costs time but no memory.
    """
    cell = np.floor(x / (radius * 0.57735))
    node = number(group, *cell.T)
    m, total, strongest = int(node.max(initial=-1)) + 1, np.zeros(len(x)), [(np.empty(0, np.int64), np.empty(0))]
    for i, j, d2 in radius_pair_blocks(x, group, radius):
        w = np.exp(-d2 / (2 * radius * radius))
        total += np.bincount(i, w, len(x)) + np.bincount(j, w, len(x))
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        out = a != b
        strongest.append(_strongest(a[out] * m + b[out], w[out]))
        if sum(len(k) for k, _ in strongest[1:]) > PAIRS:
            strongest = [_strongest(*(np.concatenate(v) for v in zip(*strongest)))]
    key, w = _strongest(*(np.concatenate(v) for v in zip(*strongest)))
    return node, key // max(m, 1), key % max(m, 1), w, total


def _strongest(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((-w, key))
    key, w = key[order], w[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return key[first], w[first]


def group_kernel(radius: float, tiled: bool, table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Clusters of the members of whole groups, or of tiles, whose clusters come with their tile."""
    ids = table.column("i").to_numpy()
    x = np.stack([table.column(c).to_numpy() for c in ("x", "y", "z")], 1)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((ids, group))  # repeated rows
    first = np.sort(order[np.append(True, (np.diff(ids[order]) != 0) | (np.diff(group[order]) != 0))])
    ids, x, group = ids[first], x[first], group[first]
    node, i, j, w, inner = affinities(x, group, radius)
    of_node = np.zeros(node.max() + 1, np.int64)
    of_node[node] = group
    label = cluster(len(of_node), i, j, w, of_node)[node]
    least = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    at = pa.array(first)
    cols = {"g": table.column("g").take(at), "i": ids, "c": least[label], "inner": inner, "size": np.bincount(label)[label]}
    if tiled:
        cols |= {c: table.column(c).take(at) for c in ("core", *TILE)}
    return pa.table(cols)


def block_kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Clusters of the nodes of unit affinities ``u, v`` in blocks of tiles: for each node the least name of its cluster, and where that lies."""
    u, v = (table.column(c).to_pylist() for c in ("u", "v"))
    names, node = np.unique(np.array([*u, *v], object), return_inverse=True)
    block = np.tile(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), 2)
    both = number(block, node)
    first = np.unique(both, return_index=True)[1]
    i, j = both[: len(u)], both[len(u) :]
    label = cluster(len(first), i, j, np.ones(len(i)), block[first])
    least = np.full(label.max() + 1, len(names))
    np.minimum.at(least, label, node[first])
    chief = np.full(label.max() + 1, -1)
    is_chief = node[first] == least[label]
    chief[label[is_chief]] = first[is_chief]
    place = [pa.chunked_array([*table.column(f"u{c}").chunks, *table.column(f"v{c}").chunks]).take(pa.array(chief[label])) for c in "xyz"]
    g = table.column("g").take(pa.array(first % len(u)))
    return pa.table({"g": g, "node": names[node[first]].tolist(), "name": names[least[label]].tolist(), **{f"n{c}": p for c, p in zip("xyz", place)}})


def join_tiles(links: DataFrame) -> DataFrame:
    """``g, node, name`` for links of nodes that lie in tiles (``g, u, ux, uy, uz, v, vx, vy, vz``): clusters over all tiles of a group.

    The same clustering as in a tile, on the graph of the tiles' clusters: what
    blocks of 4 x 4 x 4 tiles hold is clustered block by block, its clusters
    become nodes of the next level, and blocks grow fourfold until no affinity
    is left. A level keeps only what crosses the blocks of the one before.
    """
    live = materialize(links, "links")
    every = live.select("g", F.col("u").alias("node")).union(live.select("g", "v")).distinct()
    label = materialize(every.select("g", "node", F.col("node").alias("name")), "nodes")
    width = 4
    while not live.isEmpty():
        block = [F.floor(F.col(f"u{c}") / width).alias(f"b{c}") for c in "xyz"]
        same = reduce(lambda p, c: p & (F.floor(F.col(f"u{c}") / width) == F.floor(F.col(f"v{c}") / width)), "xyz", F.lit(True))
        kinds = "g string, node string, name string, nx long, ny long, nz long"
        solved = materialize(map_groups(live.where(same).select("*", *block), ["g", "bx", "by", "bz"], block_kernel, kinds), "solved")
        old_label, old_live = label, live
        step = solved.select("g", F.col("node").alias("name"), F.col("name").alias("next"))
        label = materialize(label.join(step, ["g", "name"], "left").select("g", "node", F.coalesce("next", "name").alias("name")), "nodes")
        for end in "uv":
            to = solved.select("g", F.col("node").alias(end), F.col("name").alias("_n"), *(F.col(f"n{c}").alias(f"_{c}") for c in "xyz"))
            rest = [c for c in old_live.columns if not c.startswith(end) and c != "g"]
            live = live.join(to, ["g", end], "left").select("g", F.coalesce("_n", end).alias(end), *(F.coalesce(f"_{c}", f"{end}{c}").alias(f"{end}{c}") for c in "xyz"), *rest)
        live = materialize(live.where("u <> v").distinct(), "links")
        for done in (old_label, old_live, solved):
            release(done)
        width *= 4
    return label


def similarity_clusters(df: DataFrame, group: str, item: str, axes: list[str], score: str | None = None, least_score: float = 0.88, radius: float = 3.0, least_size: int = 3, whole: int = WHOLE) -> DataFrame:
    """``g, item, cluster_id, size, affinity`` for the members of clusters of at least ``least_size``.

    Items with a score of at least ``least_score`` take part; items whose
    group, id, score or a coordinate is null, NaN or infinite don't. Two items
    of a group belong together if steps of at most ``radius`` lead from one to
    the other. cluster_id is the smallest id of the cluster; affinity is the
    sum of a member's affinities inside it. An id counts once in its group.
    """
    x = [F.col(c).cast("double").alias(v) for c, v in zip(axes, "xyz")]
    s = F.col(score).cast("double") if score else F.lit(least_score)
    rows = df.where((s >= least_score) & ~F.isnan(s)).select(F.col(group).cast("string").alias("g"), F.col(item).cast("long").alias("i"), *x)
    rows = rows.where(reduce(lambda p, v: p & (F.abs(F.col(v)) < F.lit(float("inf"))), "xyz", F.col("g").isNotNull() & F.col("i").isNotNull()))
    kinds = "g string, i long, c long, inner double, size long"
    out = lambda y: y.where(F.col("size") >= least_size).select(F.col("g").alias(group), F.col("i").alias(item), F.col("c").alias("cluster_id"), "size", F.col("inner").alias("affinity"))
    sizes = rows.groupBy("g").count().where(F.col("count") > whole).select("g")
    large = [r["g"] for r in sizes.limit(10_001).collect()]
    if not large:
        return out(map_groups(rows, ["g"], partial(group_kernel, radius, False), kinds))
    if len(large) <= 10_000:
        sizes = F.broadcast(df.sparkSession.createDataFrame([(g,) for g in large], "g string"))
    small = map_groups(rows.join(sizes, "g", "left_anti"), ["g"], partial(group_kernel, radius, False), kinds)
    big = rows.join(sizes, "g", "left_semi").distinct()  # repeated rows collapse before a tile could gather them
    # tiles of ten radii, counted from the group's corner; a member within a radius of another tile is in both
    side = 10 * radius
    corner = materialize(big.groupBy("g").agg(*(F.min(v).alias(f"o{v}") for v in "xyz")), "corners")
    cut = big.join(corner, "g")
    for v, t in zip("xyz", TILE):
        at = F.col(v) - F.col(f"o{v}") + side  # no tile has a negative number
        cut = cut.withColumn(t, F.explode(F.sequence(F.floor((at - radius) / side), F.floor((at + radius) / side)))).withColumn(f"home{v}", F.floor(at / side) == F.col(t))
    cut = cut.select("g", "i", *"xyz", *TILE, F.expr("homex AND homey AND homez").alias("core"))
    tiled = map_groups(cut, ["g", *TILE], partial(group_kernel, radius, True), kinds + ", core boolean, " + ", ".join(f"{t} long" for t in TILE))
    tiled = materialize(tiled.select("g", "i", "inner", "core", *TILE, F.concat_ws("|", *TILE, "c").alias("node")), "tiles")
    shared = tiled.join(tiled.groupBy("g", "i").agg(F.count("*").alias("n")).where("n > 1").select("g", "i"), ["g", "i"])
    end = lambda x: [F.col("node").alias(x), *(F.col(t).alias(f"{x}{c}") for t, c in zip(TILE, "xyz"))]
    links = shared.where("core").select("g", "i", *end("u")).join(shared.where("NOT core").select("g", "i", *end("v")), ["g", "i"]).drop("i").distinct()
    own = tiled.where("core").join(join_tiles(links), ["g", "node"], "left").select("g", "i", "inner", F.coalesce("name", "node").alias("node"))
    own = materialize(own, "members")
    named = own.groupBy("g", "node").agg(F.min("i").alias("c"), F.count("*").alias("size"))
    release(tiled)
    return out(small).union(out(own.join(named, ["g", "node"]).select("g", "i", "c", "inner", "size")))


def typical_members(members: DataFrame, group: str, item: str, typical: int = 3) -> DataFrame:
    """The members of each cluster with the largest affinity to it, with their ``place`` (affinities alike to nine digits: smaller id)."""
    place = F.row_number().over(Window.partitionBy(group, "cluster_id").orderBy(F.desc(F.round("affinity", 9)), item))
    return members.withColumn("place", place).where(F.col("place") <= typical)


def describe_clusters(members: DataFrame, group: str, item: str, typical: int = 3) -> DataFrame:
    """``cluster_id, group, size, typical``: each cluster with its most typical members."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda m: m[item])
    return typical_members(members, group, item, typical).groupBy(group, "cluster_id").agg(F.max("size").alias("size"), listed.alias("typical"))
