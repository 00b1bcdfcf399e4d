"""Joins by distance inside a group.

A radius join is an equi-join on (group, grid cell): one side is placed in its
cell, the other in all cells that its ball meets, and the distance decides. No
group is gathered in a task and no pair outside neighbouring cells is formed.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelmill.functions.expressions import distance2
from voxelmill.operators import kernels
from voxelmill.operators.grouped import map_groups
from voxelmill.storage import materialize

AXES = ("x", "y", "z")


#: Side of a cell in radii. At 3 a point's ball meets 4.6 cells on the average, and no more pairs are looked at than with the 27 cells of side 1 around it.
SIDE = 3.0


def in_cells(df: DataFrame, radius: float, spread: bool = False, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Adds ``cell_x, cell_y, cell_z``; with ``spread``, a row for each cell that the ball of the radius meets."""
    side, reach = SIDE * radius, radius * (1 + 1e-9)
    for axis, name in zip(AXES, axes):
        cell = lambda v: F.floor(v / side).cast("long")
        own = F.explode(F.sequence(cell(F.col(name) - reach), cell(F.col(name) + reach))) if spread else cell(F.col(name))
        df = df.withColumn(f"cell_{axis}", own)
    return df


def radius_join(left: DataFrame, right: DataFrame, group: str, radius: float, condition: Column | None = None, spread: str = "left") -> DataFrame:
    """All pairs of a group within ``radius`` (inclusive), with ``d2``.

    left has ``group, x, y, z`` and columns of its own; those of right must
    differ, but for ``group`` and the coordinates, which come back as
    ``rx, ry, rz``. ``spread`` names the side that is put into several
    cells: the smaller one.
    """
    away = tuple(f"r{a}" for a in AXES)
    right = right.select(*[c for c in right.columns if c not in AXES], *[F.col(a).alias(r) for a, r in zip(AXES, away)])
    keys = [group, *(f"cell_{a}" for a in AXES)]
    d2 = distance2([F.col(a) for a in AXES], [F.col(r) for r in away])
    pairs = in_cells(left, radius, spread == "left").join(in_cells(right, radius, spread == "right", away), keys)
    pairs = pairs.withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.drop(*keys[1:])


def radius_pairs(points: DataFrame, group: str, item: str, radius: float) -> DataFrame:
    """``group, a, b, d2`` with a < b within ``radius``."""
    left = points.select(group, F.col(item).alias("a"), *AXES)
    right = points.select(group, F.col(item).alias("b"), *AXES)
    return radius_join(left, right, group, radius, F.col("a") < F.col("b")).select(group, "a", "b", "d2")


def grow(core: DataFrame, points: DataFrame, group: str, cluster: str, item: str, radius: float) -> DataFrame:
    """``group, cluster, item``: points within ``radius`` of any core member, each once per cluster. Radius 0 keeps coincident points."""
    if radius <= 0:
        left = core.select(group, cluster, *AXES)
        return left.join(points.select(group, item, *AXES), [group, *AXES]).select(group, cluster, item).distinct()
    left = core.select(group, cluster, *AXES)
    return radius_join(left, points.select(group, item, *AXES), group, radius).select(group, cluster, item).distinct()


#: Groups of up to so many points are joined whole for queries that the first radius leaves open.
SMALL_GROUP = 5_000


def knn_join(queries: DataFrame, points: DataFrame, group: str, query: str, item: str, k: int, radius: float, exclude: Column | None = None) -> DataFrame:
    """``group, query, item, d2, rank``: the k nearest points of each query, ties by item.

    Within a radius that holds k points, these are the nearest. Queries that
    find fewer meet all points of their group if it is small; in larger groups
    they go on with twice the radius, until it spans the data.
    """
    right = points.withColumnRenamed(item, "_item")
    order = Window.partitionBy(group, query).orderBy("d2", "_item")

    def best(pairs: DataFrame) -> DataFrame:
        top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return top.select(group, query, F.col("_item").alias(item), "d2", "rank")

    def open_after(asked: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
        full = top.where(F.col("rank") == k).select(group, query)
        return top.join(full, [group, query], "left_semi"), materialize(asked.join(full, [group, query], "left_anti"), "open")

    top = materialize(best(radius_join(queries, right, group, radius, exclude)), "knn")
    done, todo = open_after(queries, top)
    found = [done]
    if todo.isEmpty():
        return done
    sizes = materialize(points.join(todo.select(group).distinct(), group, "left_semi").groupBy(group).count(), "sizes")
    small = sizes.where(F.col("count") <= SMALL_GROUP).select(group)
    far = right.select(*[c for c in right.columns if c not in AXES], *[F.col(a).alias(f"r{a}") for a in AXES])
    whole = todo.join(small, group, "left_semi").join(far.join(small, group, "left_semi"), group).withColumn("d2", distance2([F.col(a) for a in AXES], [F.col(f"r{a}") for a in AXES]))
    found.append(best(whole if exclude is None else whole.where(exclude)))
    large = sizes.where(F.col("count") > SMALL_GROUP).select(group)  # a group without points finds nothing at any radius
    todo = materialize(todo.join(large, group, "left_semi"), "open")
    if todo.isEmpty():
        return reduce(DataFrame.unionByName, found)
    ends = points.agg(*[f(a).alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    reach = sum((ends[f"h{a}"] - ends[f"l{a}"]) ** 2 for a in AXES) ** 0.5
    while not todo.isEmpty():
        radius *= 2
        top = materialize(best(radius_join(todo, right, group, radius, exclude)), "knn")
        if radius > 2 * reach:
            found.append(top)
            break
        done, todo = open_after(todo, top)
        found.append(done)
    return reduce(DataFrame.unionByName, found)


def nearest_join(queries: DataFrame, points: DataFrame, group: str, query: str, item: str, radius: float) -> DataFrame:
    """``group, query, item, d2``: the nearest point, ties by item."""
    return knn_join(queries, points, group, query, item, 1, radius).drop("rank")


def exposed(samples: DataFrame, spheres: DataFrame, group: str, owner: str) -> DataFrame:
    """Sample points that lie strictly inside no sphere but their owner's.

    spheres: ``group, owner, x, y, z, r``; the largest r sizes the grid.
    """
    widest = spheres.agg(F.max("r")).first()[0] or 1.0
    balls = spheres.select(group, F.col(owner).alias("_other"), F.col("r").alias("_r"), *AXES)
    inside = radius_join(samples, balls, group, float(widest), (F.col("_other") != F.col(owner)) & (F.col("d2") < F.col("_r") * F.col("_r")))
    keys = [group, owner, "k"]
    return samples.join(inside.select(*keys).distinct(), keys, "left_anti")


def sphere_points(atoms: DataFrame, density: float) -> DataFrame:
    """Fibonacci points on each atom's sphere: n = max(10, int(density r^2)) of them, numbered k."""
    n = F.greatest(F.lit(10), (F.col("r") * F.col("r") * density).cast("int"))
    rows = atoms.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    y = 1 - F.lit(2.0) * F.col("k") / (F.col("n") - 1)
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    angle = F.lit(2 * 3.141592653589793 / 1.618033988749895) * F.col("k")
    return rows.select(*[c for c in atoms.columns if c not in AXES], "k", (F.col("x") + F.col("r") * F.cos(angle) * flat).alias("x"), (F.col("y") + F.col("r") * y).alias("y"), (F.col("z") + F.col("r") * F.sin(angle) * flat).alias("z"))


#: Side of a block of spheres in radii of the widest, pairs of spheres whose sample points are looked at together, and how far out places are told apart.
BLOCK, TOUCHING, FAR = 40.0, 1 << 15, 1e9


def exposure(spheres: DataFrame, group: str, owner: str, density: float, widest: float) -> DataFrame:
    """``owner, exposed``, a row per sphere: its points of ``sphere_points`` that lie strictly inside no sphere of another owner of its group.

    spheres: ``group, owner, x, y, z, r`` with r up to ``widest``. Sample
    points are never rows: spheres go to blocks of space, with copies of those
    that reach in from beside, and each block meets its own pairs. A sphere
    without group or owner hides nothing and is not hidden.
    """
    side, reach = BLOCK * widest, 2.02 * widest
    block = lambda v: F.floor(v / side + 0.5).cast("long")
    rows = spheres.select(group, owner, *AXES, "r", *[block(F.col(a)).alias(f"own_{a}") for a in AXES])
    for a in AXES:
        rows = rows.withColumn(f"block_{a}", F.explode(F.sequence(block(F.col(a) - reach), block(F.col(a) + reach))))
    own = reduce(Column.__and__, [F.col(f"own_{a}") == F.col(f"block_{a}") for a in AXES])
    keys = [group, *(f"block_{a}" for a in AXES)]
    kind = dict(spheres.dtypes)[owner]
    return map_groups(rows.select(*keys, owner, *AXES, "r", own.alias("own")), keys, partial(_exposure_kernel, group, owner, density, reach), f"`{owner}` {kind}, exposed long")


def _unit_points(n: int) -> np.ndarray:
    """Factors of r in the offsets of n points, as ``sphere_points`` has them: ``cos, flat, y, sin``."""
    y = [1 - 2.0 * k / (n - 1) for k in range(n)]
    angle = [2 * 3.141592653589793 / 1.618033988749895 * k for k in range(n)]
    return np.array([[math.cos(a), math.sqrt(max(0.0, 1 - v * v)), v, math.sin(a)] for v, a in zip(y, angle)])


def _exposure_kernel(group: str, owner: str, density: float, reach: float, table: pa.Table, starts: np.ndarray) -> pa.Table:
    x = np.stack([table.column(a).to_numpy() for a in AXES], 1)
    r, own = table.column("r").to_numpy(), table.column("own").to_numpy()
    named = table.column(owner).combine_chunks()
    who = named.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    n = np.maximum(10, np.trunc(r * r * density).astype(np.int64))
    radii, size = np.unique(r, return_inverse=True)
    most = int(n.max())
    offset = np.full((len(radii), most, 3), np.nan)
    for k, v in enumerate(radii):
        unit = _unit_points(int(n[np.argmax(size == k)]))
        offset[k, : len(unit)] = np.stack([v * unit[:, 0] * unit[:, 1], v * unit[:, 2], v * unit[:, 3] * unit[:, 1]], 1)
    hidden, free = np.zeros((len(x), most), bool), own.copy()
    part = np.flatnonzero((who >= 0) & table.column(group).is_valid().to_numpy())
    where = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[part]
    for i, j, _ in kernels.radius_pair_blocks(np.clip(x[part], -FAR, FAR), where, reach, TOUCHING * 8):
        i, j = part[i], part[j]
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        meet = free[i] & (who[i] != who[j])
        i, j = i[meet], j[meet]
        for at in range(0, len(i), TOUCHING):
            a, b = i[at : at + TOUCHING], j[at : at + TOUCHING]
            a, b = a[free[a]], b[free[a]]
            d = [(x[a, c, None] + offset[size[a], :, c]) - x[b, c, None] for c in range(3)]
            row, k = np.nonzero(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < (r[b] * r[b])[:, None])
            hidden[a[row], k] = True
            met = np.unique(a)
            free[met] = hidden[met].sum(1) < n[met]
    left = n - hidden.sum(1)
    return pa.table({owner: named, "exposed": left}).filter(pa.array(own))
