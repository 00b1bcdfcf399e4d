"""An index for the most similar vectors by inner product, in any number of dimensions.

Vectors are dealt to lists, each to the centre of the largest inner product
among normed ones. What is left of a vector beside its list's centre is
quantised two axes at a time with 16 centres, four bits a pair. The
quantiser is score-aware: the part of the error that is parallel to the vector
changes its score for the queries it is near to, so it weighs ``eta`` times
the perpendicular part, over all pairs of axes jointly. Two codes make a byte,
and a query scans bytes with a table of 256 sums each. The best of a scan are
reranked by their exact inner products.

The centres are fitted on a bounded sample; every row is coded and kept in a
written table. A list is cut into blocks of bounded size, and so are the
queries that probe it, so neither a crowded list nor a popular one makes a
large task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxelmill.llm.topn import top_n_per_group
from voxelmill.operators.grouped import map_groups
from voxelmill.storage import materialize

SAMPLE = 20_000  # rows, those of the smallest hashes, on which centres are fitted: the only thing that is
THRESHOLD = 0.2  # of the cosine above which scores matter; gives the weight of the parallel error
LISTS = 1024  # at most; their centres are broadcast
CENTRES = 16
TRIALS = 200  # queries, those of the smallest hashes, on which recall is measured; they are broadcast
ROWS, QUERIES = 1 << 15, 1 << 12  # of a block, about


@dataclass
class Book:
    """``lists`` (lists x d), ``centres`` (pairs of axes x 16 x 2) and the weight of the parallel error."""

    lists: np.ndarray
    centres: np.ndarray
    eta: float

    def nearest_lists(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        score = x @ self.lists.T
        n = min(n, len(self.lists))
        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)

    def codes(self, x: np.ndarray, own: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (rows x pairs) of vectors, each pair of axes in turn chosen for the least weighed error given the others."""
        rest = _pairs(x - self.lists[own])
        u = _pairs(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
        code = np.stack([_plain(rest[:, m], self.centres[m]) for m in range(rest.shape[1])], 1)
        for _ in range(sweeps if self.eta != 1 else 0):
            along = self._along(rest, u, code)
            for m in range(rest.shape[1]):
                r = rest[:, m, None] - self.centres[m]
                p = (r * u[:, m, None]).sum(2)
                others = along - np.take_along_axis(p, code[:, m, None], 1)[:, 0]
                new = np.argmin((r * r).sum(2) + (self.eta - 1) * (p + others[:, None]) ** 2, 1)
                along = others + np.take_along_axis(p, new[:, None], 1)[:, 0]
                code[:, m] = new
        return code

    def _along(self, rest: np.ndarray, u: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The error along each vector."""
        return sum(((rest[:, m] - self.centres[m][code[:, m]]) * u[:, m]).sum(1) for m in range(rest.shape[1]))

    def pack(self, code: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if code.shape[1] % 2:
            code = np.concatenate([code, np.zeros((len(code), 1), code.dtype)], 1)
        return (code[:, 0::2] * CENTRES + code[:, 1::2]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte the sums of its 256 values."""
        one = np.einsum("qmd,mcd->qmc", _pairs(q), self.centres)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros((len(q), 1, CENTRES))], 1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Two axes at a time, the last alone with a 0."""
    if x.shape[1] % 2:
        x = np.concatenate([x, np.zeros((len(x), 1))], 1)
    return x.reshape(len(x), -1, 2)


def _plain(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(((x[:, None] - centres) ** 2).sum(2), 1)


def fit_book(x: np.ndarray, rows: int, lists: int | None = None, rounds: int = 8, seed: int = 3) -> Book:
    """Centres from a sample of a table of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    lists = max(1, min(lists or int(np.sqrt(rows) / 2), LISTS, n))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = unit[rng.choice(n, lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(unit @ centre.T, 1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-12), centre)
    own = np.argmax(unit @ centre.T, 1)
    # a centre is as long as its vectors are on the average along it
    along = np.bincount(own, (x * centre[own]).sum(1), lists) / np.maximum(np.bincount(own, minlength=lists), 1)
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    book = Book(centre * np.maximum(along, 1e-6)[:, None], np.zeros(((d + 1) // 2, CENTRES, 2)), eta)
    own = book.nearest_lists(x)[:, 0]
    rest, u = _pairs(x - book.lists[own]), _pairs(unit)
    for m in range(rest.shape[1]):
        book.centres[m] = rest[rng.choice(n, CENTRES, replace=n < CENTRES), m]
    plain = Book(book.lists, book.centres, 1.0)
    for step in range(rounds):
        b = plain if step < rounds // 2 else book  # from plain rounds on to score-aware ones
        code = b.codes(x, own)
        along = b._along(rest, u, code)
        w = b.eta - 1
        for m in range(rest.shape[1]):
            r, v, k = rest[:, m], u[:, m], code[:, m]
            others = along - ((r - b.centres[m][k]) * v).sum(1)
            # the centre of least weighed error solves (I + w v v') c = (I + w v v') r + w others v, summed over its vectors
            s = [np.bincount(k, y, CENTRES) for y in (1 + w * v[:, 0] ** 2, w * v[:, 0] * v[:, 1], 1 + w * v[:, 1] ** 2)]
            p = (r * v).sum(1) + others
            t = [np.bincount(k, r[:, a] + w * v[:, a] * p, CENTRES) for a in (0, 1)]
            det = s[0] * s[2] - s[1] ** 2
            ok = det > 1e-9
            b.centres[m][ok, 0] = (s[2][ok] * t[0][ok] - s[1][ok] * t[1][ok]) / det[ok]
            b.centres[m][ok, 1] = (s[0][ok] * t[1][ok] - s[1][ok] * t[0][ok]) / det[ok]
            along = others + ((r - b.centres[m][k]) * v).sum(1)
    return book


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _vectors(df: DataFrame, item: str, vector: str, dims: int | None) -> DataFrame:
    """``i, v``: an id once, with a vector of the right length and without nulls, NaN or infinite values."""
    v = F.col(vector).cast("array<float>")
    good = F.col("i").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0 if dims is None else F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(item).cast("long").alias("i"), v.alias("v")).where(good).groupBy("i").agg(F.min("v").alias("v"))


@dataclass
class Index:
    """The book and the written table ``list, i, code, v``."""

    book: Book
    rows: DataFrame
    dims: int


def build_index(df: DataFrame, item: str, vector: str, lists: int | None = None, sample: int = SAMPLE) -> Index | None:
    """Indexes every row; None where no row has a vector.

    Rows whose id is null, or whose vector is null, empty, of another length
    than the most common one or holds a null, NaN or infinite value, aren't
    indexed. An id counts once, with the least of its vectors. Ids are integers.
    """
    size = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return None
    once = materialize(_vectors(df, item, vector, size["d"]), "vectors")
    rows = once.count()
    if not rows:
        return None
    told = once.orderBy(F.xxhash64("i"), "i").limit(sample).toArrow()
    book = fit_book(_matrix(told.column("v")).astype(np.float64), rows, lists)
    held = df.sparkSession.sparkContext.broadcast(book)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(part.column(1)).astype(np.float64)
                own = held.value.nearest_lists(x)[:, 0]
                packed = held.value.pack(held.value.codes(x, own))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), part.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), part.column(1)], names=["list", "i", "code", "v"])

    return Index(book, materialize(once.mapInArrow(code, "list int, i long, code binary, v array<float>"), "index"), size["d"])


def _scan(held, k: int, rerank: int, table: pa.Table, starts: np.ndarray) -> pa.Table | None:
    """The k best rows of a block for each query of it: scanned by tables, the best ``rerank`` times k of them reranked."""
    book, out = held.value, []
    ids, is_q = table.column("i").to_numpy(), table.column("q").to_numpy(zero_copy_only=False)
    for s, e in zip(starts[:-1], starts[1:]):
        own = np.arange(s, e)
        rows, asked = own[~is_q[s:e]], own[is_q[s:e]]
        if not len(rows) or not len(asked):
            continue
        x, q = (_matrix(table.column("v").take(pa.array(r))) for r in (rows, asked))
        code = np.frombuffer(b"".join(table.column("code").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
        step = max(1, (1 << 22) // len(rows))
        for b in range(0, len(asked), step):
            qs = q[b : b + step]
            tables = book.tables(qs.astype(np.float64))
            score = np.zeros((len(qs), len(rows)), np.float32)
            for m in range(code.shape[1]):
                score += tables[:, m][:, code[:, m]]
            other = ids[asked[b : b + step]][:, None] != ids[rows]
            score[~other] = -np.inf
            n = min(len(rows), rerank * k)
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            exact = np.einsum("qd,qnd->qn", qs.astype(np.float64), x[best].astype(np.float64))
            exact[~np.take_along_axis(other, best, 1)] = -np.inf
            order = np.lexsort((ids[rows][best], -exact), axis=1)[:, :k]
            best, exact = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
            real = np.isfinite(exact)
            out.append((np.repeat(ids[asked[b : b + step]], best.shape[1])[real.ravel()], ids[rows][best][real], exact[real]))
    if not out:
        return None
    a, b, score = (np.concatenate(c) for c in zip(*out))
    return pa.table({"a": a, "b": b, "score": score})


def search_index(index: Index, df: DataFrame, item: str, vector: str, k: int = 3, probes: int = 16, rerank: int = 12) -> DataFrame:
    """``a, b, score, place``: for every query the k indexed vectors of the largest inner product, itself left out; ties go to the smaller id.

    The answer is that of the ``probes`` lists nearest to the query, and of
    them of the ``rerank`` times k best scanned rows of each block.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(index.book)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                lists = held.value.nearest_lists(_matrix(part.column(1)), probes)
                of = pa.array(np.repeat(np.arange(part.num_rows), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), part.column(0).take(of), part.column(1).take(of)], names=["list", "i", "v"])

    asked = materialize(_vectors(df, item, vector, index.dims).mapInArrow(probe, "list int, i long, v array<float>"), "queries")
    cut = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    sizes = index.rows.groupBy("list").agg(cut(F.count("*"), ROWS).alias("rb")).join(asked.groupBy("list").agg(cut(F.count("*"), QUERIES).alias("qb")), "list")  # a row a list
    sizes = F.broadcast(materialize(sizes, "blocks"))
    part = lambda n: F.pmod(F.xxhash64("i"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = index.rows.join(sizes, "list").select("list", part(F.col("rb")).alias("r"), every(F.col("qb")).alias("s"), F.lit(False).alias("q"), "i", "code", "v")
    queries = asked.join(sizes, "list").select("list", every(F.col("rb")).alias("r"), part(F.col("qb")).alias("s"), F.lit(True).alias("q"), "i", F.lit(None).cast("binary").alias("code"), "v")
    found = map_groups(rows.union(queries), ["list", "r", "s"], partial(_scan, held, k, rerank), "a long, b long, score double")
    return top_n_per_group(found, "a", "b", "score", None, k).select("a", "b", "score", "place")


def _exact(held, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best of a task's rows for each of the held queries (ids, vectors)."""
    asked, q = held.value
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            ids = part.column(0).to_numpy()
            score = q.astype(np.float64) @ _matrix(part.column(1)).astype(np.float64).T
            score[asked[:, None] == ids] = -np.inf
            best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            score = np.take_along_axis(score, best, 1)
            real = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, best.shape[1])[real.ravel()]), pa.array(ids[best][real]), pa.array(score[real])], names=["a", "b", "score"])


def measure_recall(index: Index, k: int = 3, target: float = 0.9, probes: int = 8, rerank: int = 12, trials: int = TRIALS) -> tuple[int, float]:
    """The least number of probes, doubled from ``probes``, with which a search finds the ``target`` share of the true k nearest of ``trials`` rows, and that share.

    The truth is brute force: the trial vectors against every indexed row. With
    as many probes as lists only the scan can miss anything.
    """
    spark = index.rows.sparkSession
    told = index.rows.select("i", "v").orderBy(F.xxhash64("i", F.lit(9)), "i").limit(trials)
    told = materialize(told, "trials")
    rows = told.toArrow()
    held = spark.sparkContext.broadcast((rows.column("i").to_numpy(), _matrix(rows.column("v"))))
    near = index.rows.select("i", "v").mapInArrow(partial(_exact, held, k), "a long, b long, score double")
    truth = materialize(top_n_per_group(near, "a", "b", "score", None, k).select("a", "b"), "truth")
    wanted = truth.count()
    while True:
        found = search_index(index, told, "i", "v", k, probes, rerank).select("a", "b")
        recall = found.join(truth, ["a", "b"], "left_semi").count() / wanted if wanted else 1.0
        if recall >= target or probes >= len(index.book.lists):
            return min(probes, len(index.book.lists)), recall
        probes *= 2
