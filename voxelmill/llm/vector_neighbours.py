"""The k most similar vectors of the same group for every vector.

A vector x is lifted to the pairs (x_d, -x_d^2/2); against the query pairs
(q_d, 1) the inner product is <q, x> - |x|^2/2, so the nearest vectors are
those of maximum inner product. Lifted vectors are quantised axis by axis with
16 centres (four bits). The quantiser is score-aware: residuals along the
direction that near queries have weigh ``ETA`` times, as these alone change the
score of near vectors. A query scans the codes with one look-up table for two
axes; what can still be among the k nearest within the bounds of its residuals
is reranked with exact distances, so nothing is lost.

Small groups are searched as wholes. Large ones are cut into tiles with a halo;
a query whose k-th distance reaches beyond the halo is searched again in every
tile that its ball meets.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelmill.operators.grouped import map_groups
from voxelmill.storage import materialize

LEAF = 256  # queries scanned together
ETA = 4.0  # weight of the residual that is parallel to near queries
SAMPLE = 4096  # vectors of a task that the codebook is fitted on; all are coded
CENTRES, BINS = 16, 2048
#: Rows of a group beyond which it is cut into tiles.
WHOLE = 20_000
#: Large groups up to which they are named in the plan.
NAMED = 200
#: Large groups up to which their list is broadcast (some 100 bytes each); more are joined by shuffle.
LISTED = 50_000


def fit_codebook(t: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """16 centres (c1, c2) for lifted values (t, -t^2/2), t in -1..1, and the code of each of ``BINS`` bins of t.

    Lloyd rounds under the loss |r|^2 + (ETA - 1) (r . u)^2, u the direction of (t, 1).
    """
    grid = np.linspace(-1, 1, CENTRES)
    c = np.stack([grid, -grid * grid / 2])
    norm = np.sqrt(t * t + 1)
    u1, u2, l1, l2 = t / norm, 1 / norm, t, -t * t / 2
    a11, a12, a22 = 1 + (ETA - 1) * u1 * u1, (ETA - 1) * u1 * u2, 1 + (ETA - 1) * u2 * u2

    def nearest(x: np.ndarray) -> np.ndarray:
        n = np.sqrt(x * x + 1)
        r1, r2 = x[:, None] - c[0], -x[:, None] ** 2 / 2 - c[1]
        return np.argmin(r1 * r1 + r2 * r2 + (ETA - 1) * ((x / n)[:, None] * r1 + (1 / n)[:, None] * r2) ** 2, axis=1)

    for _ in range(rounds if len(t) else 0):
        k = nearest(t)
        s = [np.bincount(k, x, CENTRES) for x in (a11, a12, a22, a11 * l1 + a12 * l2, a12 * l1 + a22 * l2)]
        det = s[0] * s[2] - s[1] * s[1]
        ok = det > 1e-12
        c[0, ok] = (s[2][ok] * s[3][ok] - s[1][ok] * s[4][ok]) / det[ok]
        c[1, ok] = (s[0][ok] * s[4][ok] - s[1][ok] * s[3][ok]) / det[ok]
    return c, nearest((np.arange(BINS) + 0.5) / BINS * 2 - 1).astype(np.uint8)


def scan(x: np.ndarray, q: np.ndarray, c: np.ndarray, k: int, book: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of vectors ``c`` (row numbers of x) for each of ``q``, ties at the k-th distance included, itself left out.

    Returns position in q, row number, squared distance; and the squared k-th distance of each query (inf if it has fewer).
    """
    centres, codes = book
    at, dims = x[c], x.shape[1]
    low, high = at.min(0), at.max(0)
    mid, half = (low + high) / 2, np.maximum((high - low) / 2, 1e-9)
    t = (at - mid) / half
    code = codes[np.clip(((t + 1) * (BINS / 2)).astype(np.int32), 0, BINS - 1)]
    r1, r2 = t - centres[0][code], -t * t / 2 - centres[1][code]
    w = half * half
    slope = np.sqrt(((half * r1) ** 2).sum(1).max())  # error of a score per unit of distance
    own = np.abs((w * (t * r1 + r2)).sum(1)).max()  # error at distance 0
    slack = 1e-5 * (w.sum() + ((x[q] - mid) ** 2).sum(1).max())
    found = []
    step = max(1, (1 << 21) // len(c))
    for b in range(0, len(q), step):
        own_q = q[b : b + step]
        qc = (x[own_q] - mid) / half
        table = [-2 * w[d] * (centres[0][:, None] * qc[:, d] + centres[1][:, None]) for d in range(dims)]
        score = None
        for d in range(0, dims, 2):
            if d + 1 < dims:
                pair = (table[d][:, None, :] + table[d + 1][None, :, :]).reshape(CENTRES * CENTRES, -1).astype(np.float32)
                part = pair[code[:, d].astype(np.int32) * CENTRES + code[:, d + 1]]
            else:
                part = table[d].astype(np.float32)[code[:, d]]
            score = part if score is None else np.add(score, part, out=score)
        n, m = score.shape
        # an upper bound of the (k+1)-th least score: of disjoint parts of the vectors, the least of each
        parts = 8 * (k + 1)
        least = score
        if n > 2 * parts:
            whole = n // parts * parts
            least = score[:whole].reshape(n // parts, parts, m).min(0)
            least[: n - whole] = np.minimum(least[: n - whole], score[whole:])
        norm2 = ((x[own_q] - mid) ** 2).sum(1)
        if n > k:
            bound = np.partition(least, k, axis=0)[k] + norm2
            reach = slope + np.sqrt(np.maximum(bound + 2 * own + slack + slope * slope, 0))
            limit = reach * reach + 2 * reach * slope + 2 * own + slack - norm2
            flat = np.flatnonzero(np.ascontiguousarray((score <= limit.astype(np.float32) + np.float32(slack)).T))
        else:
            flat = np.arange(n * m)
        i, j = np.divmod(flat, n)
        row = c[j]
        other = row != own_q[i]
        i, row = i[other], row[other]
        d2 = np.zeros(len(i))
        for d in range(dims):
            diff = x[own_q[i], d] - x[row, d]
            d2 += diff * diff
        count = np.bincount(i, minlength=m)
        wide = int(count.max()) if len(count) else 0
        if wide >= k:
            padded = np.full((m, wide), np.inf)
            padded[i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)] = d2
            kth = np.partition(padded, k - 1, axis=1)[:, k - 1]
        else:
            kth = np.full(m, np.inf)
        keep = d2 <= kth[i]
        found.append((i[keep] + b, row[keep], d2[keep], kth))
    return tuple(np.concatenate([f[j] for f in found]) for j in range(4))


def _leaves(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Median splits on the widest axis, down to ``LEAF`` rows."""
    todo, out = [rows], []
    while todo:
        r = todo.pop()
        if len(r) <= LEAF:
            out.append(r)
            continue
        p = x[r]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argpartition(p[:, axis], len(r) // 2)
        todo += [r[order[: len(r) // 2]], r[order[len(r) // 2 :]]]
    return out


def search(x: np.ndarray, queries: np.ndarray, k: int, book: tuple, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[tuple], list[tuple]]:
    """Exact neighbours of the rows ``queries``. known: the box that x covers; outside there may be more vectors. None: x is all.

    Returns parts (query rows, neighbour rows, squared distances) and, of those whose k-th distance leaves the known box, (query rows, squared k-th distances).
    """
    everything = np.arange(len(x))
    low_all, high_all = x.min(0), x.max(0)
    parts, unsure = [], []
    for leaf in _leaves(x, queries):
        radius, todo = None, leaf
        while len(todo):
            low, high = x[todo].min(0), x[todo].max(0)
            if radius is None:
                side = np.prod(np.maximum(high - low, 1e-3)) ** (1 / x.shape[1])
                radius = 2.2 * side * (0.24 * (k + 1) / len(todo)) ** (1 / x.shape[1])
            low, high = low - radius, high + radius
            full = len(x) <= 2 * LEAF or bool((low <= low_all).all() and (high >= high_all).all())
            if full:
                c = everything
            else:
                inside = np.ones(len(x), bool)
                for d in range(x.shape[1]):
                    inside &= (x[:, d] >= low[d]) & (x[:, d] <= high[d])
                c = np.flatnonzero(inside)
            i, row, d2, kth = scan(x, todo, c, k, book)
            p = x[todo]
            if full:
                reach = np.full(len(todo), np.inf) if known is None else np.minimum(p - known[0], known[1] - p).min(1)
            else:
                outer = (low_all, high_all) if known is None else known
                below = np.where((low <= outer[0]) & (known is None), np.inf, p - np.maximum(low, outer[0]))
                above = np.where((high >= outer[1]) & (known is None), np.inf, np.minimum(high, outer[1]) - p)
                reach = np.minimum(below, above).min(1)
            sure = kth <= np.maximum(reach, 0) ** 2 * (1 - 1e-12)
            sure |= np.isinf(reach)
            keep = sure[i]
            parts.append((todo[i[keep]], row[keep], d2[keep]))
            if full and not sure.all():
                unsure.append((todo[~sure], kth[~sure]))
            todo, radius = (todo[:0] if full else todo[~sure]), radius * 2
    return parts, unsure


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(n).to_numpy(zero_copy_only=False) for n in names]


def _book(x: np.ndarray, starts: np.ndarray) -> tuple:
    """The codebook of a task, fitted on its first chunk: values scaled to the boxes of their groups."""
    t = []
    for a, b in zip(starts[:-1], starts[1:]):
        p = x[a : min(b, a + SAMPLE)]
        low, high = p.min(0), p.max(0)
        t.append(((p - (low + high) / 2) / np.maximum((high - low) / 2, 1e-9)).ravel())
        if sum(map(len, t)) >= SAMPLE:
            break
    return fit_codebook(np.concatenate(t)[:SAMPLE])


def whole_kernel(axes: list[str], k: int, paired: bool, state: dict, table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Groups searched as wholes. paired: unordered pairs, each once, instead of directed ones."""
    ids, x = table.column("i").to_numpy(), np.stack(_columns(table, axes), 1)
    book = state.setdefault("book", None) or state.update(book=_book(x, starts)) or state["book"]
    a, b, d = [], [], []
    for s, e in zip(starts[:-1], starts[1:]):
        own, first = np.unique(ids[s:e], return_index=True)
        p = x[s:e][first]
        for q, row, d2 in search(p, np.arange(len(p)), k, book)[0]:
            a.append(own[q]), b.append(own[row]), d.append(d2)
    a, b, d = (np.concatenate(v) if v else np.empty(0) for v in (a, b, d))
    if paired:
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        low, high, d = low[order], high[order], d[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        a, b, d = low[new], high[new], d[new]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "d": np.sqrt(d.astype(float))})


def tile_kernel(axes: list[str], k: int, state: dict, table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Tiles with a halo; rows whose neighbours aren't sure come back with b null, d the distance known to hold k (null: none) and their place."""
    ids, core, x = table.column("i").to_numpy(), table.column("core").to_numpy(zero_copy_only=False), np.stack(_columns(table, axes), 1)
    box = np.stack(_columns(table, [*(f"low_{v}" for v in axes), *(f"high_{v}" for v in axes)]), 1)
    book = state.setdefault("book", None) or state.update(book=_book(x, starts)) or state["book"]
    group, n = table.column("g"), len(axes)
    out = []
    for s, e in zip(starts[:-1], starts[1:]):
        own, first = np.unique(ids[s:e], return_index=True)
        p, inner = x[s:e][first], np.flatnonzero(core[s:e][first])
        if not len(inner):
            continue
        parts, unsure = search(p, inner, k, book, (box[s, :n], box[s, n:]))
        for q, row, d2 in parts:
            out.append((s, own[q], own[row], np.sqrt(d2), None))
        for q, kth in unsure:
            out.append((s, own[q], None, np.sqrt(kth), p[q]))
    if not out:
        return None
    g = group.take(pa.array(np.concatenate([np.full(len(o[1]), o[0]) for o in out])))
    b = pa.concat_arrays([pa.nulls(len(o[1]), pa.int64()) if o[2] is None else pa.array(o[2], pa.int64()) for o in out])
    cols = {"g": g, "a": pa.array(np.concatenate([o[1] for o in out]), pa.int64()), "b": b, "d": np.concatenate([o[3] for o in out])}
    for j, v in enumerate(axes):
        cols[v] = pa.concat_arrays([pa.nulls(len(o[1]), pa.float64()) if o[4] is None else pa.array(o[4][:, j]) for o in out])
    return pa.table(cols)


def open_kernel(axes: list[str], k: int, state: dict, table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Open queries (q) against all vectors of one tile: the tile's k nearest for each."""
    ids, is_q, x = table.column("i").to_numpy(), table.column("q").to_numpy(zero_copy_only=False), np.stack(_columns(table, axes), 1)
    book = state.setdefault("book", None) or state.update(book=_book(x, starts)) or state["book"]
    out = []
    for s, e in zip(starts[:-1], starts[1:]):
        own, q = np.arange(s, e), is_q[s:e]
        points, asked = own[~q], own[q]
        points = points[np.unique(ids[points], return_index=True)[1]]
        if not len(points) or not len(asked):
            continue
        both = np.concatenate([points, asked])
        i, row, d2, _ = scan(x[both], len(points) + np.arange(len(asked)), np.arange(len(points)), k + 1, book)
        other = ids[asked[i]] != ids[points[row]]
        out.append((ids[asked[i]][other], ids[points[row]][other], d2[other]))
    if not out:
        return None
    a, b, d2 = (np.concatenate([o[j] for o in out]) for j in range(3))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "d": np.sqrt(d2)})


def _cells(axes: list[str], margin: Column) -> list[Column]:
    """For each axis the numbers of the tiles that value +- margin meets."""
    cell = lambda v: F.floor(v / F.col("side")).cast("int")
    return [F.sequence(cell(F.col(v) - F.col(f"o_{v}") - margin), cell(F.col(v) - F.col(f"o_{v}") + margin)).alias(f"t_{v}") for v in axes]


def _explode(df: DataFrame, axes: list[str]) -> DataFrame:
    for v in axes:
        df = df.withColumn(f"t_{v}", F.explode(f"t_{v}"))
    return df


def _with_tiling(df: DataFrame, tiling: DataFrame, groups: int) -> DataFrame:
    """Joins a group's tiling to its rows: as a constant of the plan for few groups, by broadcast for more, by shuffle beyond."""
    if groups > NAMED:
        return df.join(F.broadcast(tiling) if groups <= LISTED else tiling, "g")
    rows = tiling.collect()
    if not rows:
        return df.join(tiling, "g")
    told = [x for r in rows for x in (F.lit(r["g"]), F.struct(*(F.lit(float(r[c])).alias(c) for c in tiling.columns[1:])))]
    return df.withColumn("_t", F.element_at(F.create_map(*told), F.col("g"))).select(*df.columns, "_t.*")


def _tilings(big: DataFrame, axes: list[str], whole: int, groups: int) -> DataFrame:
    """Per large group: its origin and tile side, such that no tile holds over 4 times ``whole`` rows, unless they lie within a millionth of its extent."""
    aggs = [F.count("*").alias("n")] + [f(v).alias(f"{p}_{v}") for v in axes for f, p in ((F.min, "o"), (F.max, "z"))]
    ends = big.groupBy("g").agg(*aggs)
    extent = reduce(F.greatest, (F.col(f"z_{v}") - F.col(f"o_{v}") for v in axes), F.lit(1e-6))
    volume = reduce(lambda p, v: p * F.greatest(F.col(f"z_{v}") - F.col(f"o_{v}"), extent * 1e-3), axes, F.lit(1.0))
    tiling = materialize(ends.select("g", *(f"o_{v}" for v in axes), F.pow(volume * whole / F.col("n"), F.lit(1 / len(axes))).alias("side"), (extent * 1e-6).alias("least")), "tiling")
    while True:
        cells = [F.floor((F.col(v) - F.col(f"o_{v}")) / F.col("side")).alias(f"t_{v}") for v in axes]
        full = _with_tiling(big, tiling, groups).where("side > least").groupBy("g", *cells).count().groupBy("g").agg(F.max("count").alias("most")).where(F.col("most") > 4 * whole)
        full = materialize(full.select("g"), "full")
        if full.isEmpty():
            return tiling
        halved = tiling.join(full.withColumn("over", F.lit(True)), "g", "left")
        tiling = materialize(halved.select("g", *(f"o_{v}" for v in axes), F.when(F.col("over"), F.col("side") / 2).otherwise(F.col("side")).alias("side"), "least"), "tiling")


def nearest_vectors(df: DataFrame, group: str, item: str, axes: list[str], k: int = 3, paired: bool = False, whole: int = WHOLE) -> DataFrame:
    """``a, b, distance``: b is among the k nearest other items of a's group by Euclidean distance.

    All items at the k-th smallest distance count; a group with fewer items
    gives all it has. Items whose group, id or a coordinate is null, NaN or
    infinite take no part; an id counts once in its group (of differing rows,
    one is taken). Ids are integers. paired: every unordered pair once, a < b.
    """
    names = [f"v{j}" for j in range(len(axes))]
    finite = reduce(lambda p, v: p & (F.abs(F.col(v)) < F.lit(float("inf"))), names, F.col("g").isNotNull() & F.col("i").isNotNull())
    points = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("long").alias("i"), *(F.col(c).cast("double").alias(v) for c, v in zip(axes, names))).where(finite)
    sizes = df.groupBy(F.col(group).cast("string").alias("g")).count().where(F.col("count") > whole).select("g")
    large = [r["g"] for r in sizes.limit(LISTED + 1).collect()]
    kinds = "a long, b long, d double"
    found = lambda x: x.select("a", "b", F.col("d").alias("distance"))
    if not large:
        return found(map_groups(points, ["g"], partial(whole_kernel, names, k, paired, {}), kinds))
    sizes = F.broadcast(df.sparkSession.createDataFrame([(g,) for g in large], "g string")) if NAMED < len(large) <= LISTED else sizes
    named = len(large) <= NAMED
    of = lambda x, how: x.where(F.col("g").isin(large) if how == "left_semi" else ~F.col("g").isin(large)) if named else x.join(sizes, "g", how)
    small = found(map_groups(of(points, "left_anti"), ["g"], partial(whole_kernel, names, k, paired, {}), kinds))
    # repeated rows collapse before a tile could gather them; later steps read this table instead of the source
    big = materialize(of(points, "left_semi").distinct(), "large")
    tiling = _tilings(big, names, whole, len(large))
    tiled = lambda x: _with_tiling(x, tiling, len(large))
    tiles = [f"t_{v}" for v in names]
    placed = tiled(big)
    halo = F.col("side") / 8
    spread = _explode(placed.select("*", *_cells(names, halo)), names)
    edge = lambda v, up: F.col(f"o_{v}") + (F.col(f"t_{v}") + up) * F.col("side") + (halo if up else -halo)
    core = reduce(lambda p, v: p & (F.floor((F.col(v) - F.col(f"o_{v}")) / F.col("side")).cast("int") == F.col(f"t_{v}")), names, F.lit(True))
    rows = spread.select("g", *tiles, "i", *names, core.alias("core"), *(edge(v, 0).alias(f"low_{v}") for v in names), *(edge(v, 1).alias(f"high_{v}") for v in names))
    first = materialize(map_groups(rows, ["g", *tiles], partial(tile_kernel, names, k, {}), "g string, a long, b long, d double, " + ", ".join(f"{v} double" for v in names)), "tiles")
    asked = first.where("b IS NULL")
    parts = [found(first.where("b IS NOT NULL"))]
    if not asked.isEmpty():
        # the ball that holds k others, or, where none is known, every tile of the group
        asked = asked.select("g", F.col("a").alias("i"), *names, "d").transform(tiled)
        near = (F.col("d") < F.lit(float("inf"))) & (F.col("d") < 4 * F.col("side"))
        balls = _explode(asked.where(near).select("*", *_cells(names, F.col("d") * (1 + 1e-9))), names).select("g", *tiles, "i", *names)
        own = [F.floor((F.col(v) - F.col(f"o_{v}")) / F.col("side")).cast("int").alias(f"t_{v}") for v in names]
        homes = placed.select("g", *own, "i", *names)
        rest = asked.where(~near).select("g", "i", *names).join(homes.select("g", *tiles).distinct(), "g").select("g", *tiles, "i", *names)
        queries = balls.union(rest).withColumn("q", F.lit(True))
        wanted = homes.join(queries.select("g", *tiles).distinct(), ["g", *tiles], "left_semi").withColumn("q", F.lit(False))
        again = map_groups(queries.unionByName(wanted), ["g", *tiles], partial(open_kernel, names, k, {}), kinds)
        order = Window.partitionBy("a").orderBy("d")
        parts.append(found(again.withColumn("r", F.rank().over(order)).where(F.col("r") <= k)))
    union = reduce(DataFrame.union, parts)
    if paired:
        union = union.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("distance").alias("distance"))
    return small.union(union)
