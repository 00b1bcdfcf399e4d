"""Group kernels over sorted Arrow batches.

``groupBy().applyInArrow`` calls Python once a group, which for many small
groups costs more than the work. Here a partition that is sorted by its key is
cut into chunks of whole groups, so a kernel handles many groups at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins, 0 left out."""
    if len(table) < 2:
        return np.empty(0, np.int64)
    new = np.zeros(len(table) - 1, bool)
    for key in keys:
        col = table.column(key).combine_chunks()
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        differ = pc.not_equal(a, b)
        if col.null_count:
            differ = pc.fill_null(differ, True)
            differ = pc.and_(differ, pc.invert(pc.and_(a.is_null(), b.is_null())))
        new |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Chunks of whole groups with the row numbers at which groups begin, the end included."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            new_at_0 = len(_changes(seam, keys)) > 0
        else:
            new_at_0 = False
        at = _changes(pa.Table.from_batches([batch]), keys)
        last = int(at[-1]) if len(at) else (0 if new_at_0 else None)
        if last is None:
            held.append(batch)
            continue
        done = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
        held = [batch.slice(last)]
        if len(done):
            yield done, np.concatenate([[0], _changes(done, keys), [len(done)]])
    if held:
        done = pa.Table.from_batches(held).combine_chunks()
        yield done, np.concatenate([[0], _changes(done, keys), [len(done)]])


def map_groups(df: DataFrame, keys: list[str], kernel: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str, order: list[str] = ()) -> DataFrame:
    """Applies ``kernel`` to chunks of whole groups; one shuffle on the keys.

    Every group must fit a task: callers cut groups without a size bound first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            out = kernel(table, starts)
            if out is not None and len(out):
                yield from out.to_batches(max_chunksize=100_000)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, dealt to all of them; larger scans are left as they are. For work that costs far more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
