"""Score cutoffs that keep a target share of every source.

Distributed quickselect. Every task reports, for each source, how many of its
open scores lie above, at and below the pivot, with the medians of both sides.
The weighted median of those medians is the next pivot; the counts tell which
side the wanted rank is on, and the other side is discarded. When few scores
are left open, the wanted one is read off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.storage import materialize, release

#: Sources that one selection handles; more are handled in further selections.
SOURCES = 10_000


def _sides(state: dict[int, tuple[float, float, float]]):
    """Per task and source: counts and medians on both sides of the pivot. state: low, high (both outside), pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, p = [], []
        low, high = (np.full(max(state) + 1, x) for x in (np.inf, -np.inf))
        for k, (a, b, _) in state.items():
            low[k], high[k] = a, b
        for batch in batches:
            k, x = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 1))
            ok = k < len(low)
            k, x = k[ok], x[ok]
            keep = (x > low[k]) & (x < high[k])
            t.append(k[keep])
            p.append(x[keep])
        rows = []
        if t:
            t, p = np.concatenate(t), np.concatenate(p)
            order = np.argsort(t, kind="stable")
            t, p = t[order], p[order]
            for k in np.unique(t):
                x = p[np.searchsorted(t, k) : np.searchsorted(t, k, "right")]
                pivot = state[int(k)][2]
                up, down = x[x > pivot], x[x < pivot]
                rows.append((int(k), len(up), len(x) - len(up) - len(down), len(down), float(np.median(up)) if len(up) else None, float(np.median(down)) if len(down) else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["t", "up", "at", "down", "mu", "md"])

    return run


def _pass(values: DataFrame, state: dict) -> dict[int, tuple]:
    seen = values.select("t", "p").mapInArrow(_sides(state), "t int, up long, at long, down long, mu double, md double")
    total = seen.groupBy("t").agg(
        F.sum("up").alias("up"), F.sum("at").alias("at"), F.sum("down").alias("down"),
        F.expr("percentile(mu, 0.5, greatest(up, 1))").alias("mu"), F.expr("percentile(md, 0.5, greatest(down, 1))").alias("md"),
    )
    return {r["t"]: r for r in total.collect()}



def _select(values: DataFrame, share: dict[int, float], finish: int) -> dict[int, tuple[int, int, float]]:
    """n, k and the cutoff of every source that has scores."""
    spark = values.sparkSession
    out: dict[int, tuple[int, int, float]] = {}
    state = {t: (-math.inf, math.inf, 0.5) for t in share}
    first, wanted, sizes = True, {}, {}
    stored, stored_rows = values, None
    while state:
        seen, open_now, left = _pass(stored, state), {}, 0
        for t, r in seen.items():
            low, high, pivot = state[t]
            if first:
                n = r["up"] + r["at"] + r["down"]
                wanted[t] = max(1, math.floor(n * share[t]))
                sizes[t] = (n, wanted[t])
            if wanted[t] <= r["up"]:
                open_now[t], size = (pivot, high, r["mu"]), r["up"]
            elif wanted[t] <= r["up"] + r["at"]:
                out[t] = (*sizes[t], pivot)
                continue
            else:
                wanted[t] -= r["up"] + r["at"]
                open_now[t], size = (low, pivot, r["md"]), r["down"]
            left += size
            if size <= finish:
                open_now[t] = (*open_now[t], "last")
        stored_rows = stored_rows or sum(n for n, _ in sizes.values())
        first = False
        last = {t: x[:2] for t, x in open_now.items() if len(x) == 4}
        state = {t: x for t, x in open_now.items() if len(x) == 3}
        if last:
            bounds = F.broadcast(spark.createDataFrame([(t, float(a), float(b), int(wanted[t])) for t, (a, b) in last.items()], "t int, a double, b double, w int"))
            rest = stored.select("t", "p").join(bounds, "t").where("p > a AND p < b").groupBy("t")
            for r in rest.agg(F.element_at(F.sort_array(F.collect_list("p"), asc=False), F.max("w")).alias("cut")).collect():
                out[r["t"]] = (*sizes[r["t"]], r["cut"])
        if state and left < stored_rows / 4:  # what is discarded is not read again
            bounds = F.broadcast(spark.createDataFrame([(t, float(a), float(b)) for t, (a, b, _) in state.items()], "t int, a double, b double"))
            kept = materialize(stored.join(bounds, "t").where("p > a AND p < b").select("t", "p"), "open")
            if stored is not values:
                release(stored)
            stored, stored_rows = kept, left
    if stored is not values:
        release(stored)
    return out


def cutoffs(df: DataFrame, source: str, item: str, score: str, targets: DataFrame, target_source: str, target_share: str, finish: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Returns the cutoffs (``source, n, k, cutoff, kept``) and the kept rows (``source, item, score``).

    Source names count trimmed and lower-case. n is the number of items of a
    source with a score in 0..1; the cutoff is the k-th highest of these
    scores, k = max(1, floor(n * share)), and every item at or above it is
    kept, ties included. Null, NaN and outlying scores, null items and null
    sources count nowhere; an item counts once in a source, with its highest
    score there. A source without a share, or whose share is null, gives no
    row; nor does a source without scores. Sources with several shares have
    the largest.
    """
    spark = df.sparkSession
    name = lambda c: F.lower(F.trim(F.col(c)))
    wanted = targets.select(name(target_source).alias("source"), F.col(target_share).cast("double").alias("share")).where("source IS NOT NULL AND share IS NOT NULL AND NOT isnan(share)").groupBy("source").agg(F.max("share").alias("share"))
    blocks = max(1, -(-wanted.count() // SOURCES))
    reports, kept = [], []
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("source"), F.lit(blocks)) == b).orderBy("source").collect()
        if not rows:
            continue
        codes = F.broadcast(spark.createDataFrame([(r["source"], t) for t, r in enumerate(rows)], "source string, t int"))
        scored = df.select(name(source).alias("source"), F.col(item).alias("i"), F.col(score).cast("double").alias("p")).where("i IS NOT NULL AND p >= 0 AND p <= 1")
        once = scored.join(codes, "source").groupBy("t", "i").agg(F.max("p").alias("p"))
        values = materialize(once.select("t", "p", "i"), "scores")
        found = _select(values, {t: r["share"] for t, r in enumerate(rows)}, finish)
        cut = F.broadcast(spark.createDataFrame([(t, rows[t]["source"], n, k, float(c)) for t, (n, k, c) in found.items()], "t int, source string, n long, k long, cutoff double"))
        above = values.join(cut, "t").where("p >= cutoff")
        kept.append(above.select(F.col("source").alias(source), F.col("i").alias(item), F.col("p").alias(score)))
        reports.append(above.groupBy("source", "n", "k", "cutoff").agg(F.count("*").alias("kept")))
    if not kept:
        kept = [df.select(F.col(source), F.col(item), F.col(score).cast("double").alias(score)).limit(0)]
        reports = [spark.createDataFrame([], "source string, n long, k long, cutoff double, kept long")]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(reports), union(kept)
