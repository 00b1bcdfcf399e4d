"""The N best items of every group.

Every task keeps a heap of the N best distinct items for each group it meets,
as one run sorted by group and order into which batches are merged; a row of an
item that the heap holds already can only replace it by a better one. Heaps are
built before the only shuffle and merged after it, so a group of any size costs
a task N rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxelmill.operators.grouped import map_groups

BATCH = 1 << 16  # rows merged at a time, at least
#: Rows of heaps that a task holds before it hands them on and begins anew.
HELD = 1 << 19
ORDER = [("g", "ascending"), ("s", "descending"), ("r", "ascending"), ("i", "ascending")]


def heap(rows: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
    """The n best rows of distinct items of every group ``g``, sorted, and the place of each, 1 first. Null ranks come last."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=ORDER, null_placement="at_end"))
    item = _codes(rows, "i")
    key = _codes(rows, "g") * (item.max(initial=0) + 1) + item
    rows = rows.take(pa.array(np.sort(np.unique(key, return_index=True)[1])))  # of each item its first row, which is its best
    g = _codes(rows, "g")
    place = np.arange(len(g)) - np.flatnonzero(np.diff(g, prepend=-1))[g] + 1
    keep = np.flatnonzero(place <= n)
    return rows.take(pa.array(keep)), place[keep]


def _codes(rows: pa.Table, column: str) -> np.ndarray:
    """Numbers of a column's values in the order of their first rows."""
    return pc.dictionary_encode(rows.column(column).combine_chunks()).indices.to_numpy().astype(np.int64)


def _build(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, waiting, count = None, [], 0
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count > max(BATCH, 0 if held is None else len(held)):  # a row is merged a bounded number of times
            new = pa.Table.from_batches(waiting)
            held, _ = heap(new if held is None else pa.concat_tables([held, new]), n)
            waiting, count = [], 0
            if len(held) > HELD:
                yield from held.combine_chunks().to_batches()
                held = None
    if count:
        new = pa.Table.from_batches(waiting)
        held, _ = heap(new if held is None else pa.concat_tables([held, new]), n)
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _merge(n: int, table: pa.Table, starts: np.ndarray) -> pa.Table:
    best, place = heap(table, n)
    return best.append_column("place", pa.array(place.astype(np.int32)))


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, rank: str | None = None, n: int = 5) -> DataFrame:
    """Returns ``group, item, score, rank, place`` with place 1 to n.

    Order: score from high to low, then smaller rank (null last), then smaller
    item id. An item counts once in a group, with the best of its rows in that
    order. Rows whose group, item or score is null, or whose score is NaN,
    never count. An empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kinds = dict(df.dtypes)
    r = F.col(rank) if rank else F.lit(None)
    # adding 0 makes -0.0 equal to 0.0
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + 0.0).alias("s"), r.cast("long").alias("r"))
    rows = rows.where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    kind = f"g {kinds[group]}, i {kinds[item]}, s double, r long"
    heaps = rows.mapInArrow(partial(_build, n), kind)
    out = map_groups(heaps, ["g"], partial(_merge, n), kind + ", place int")
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias(rank or "rank"), "place")
