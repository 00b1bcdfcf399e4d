"""The index of vectors: recall against brute force, crowded lists, odd rows."""

import numpy as np
import pytest

from voxelmill.llm import vector_index as V
from voxelmill.llm.queries import queries


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, vec array<double>").selectExpr("id", "vec", "'z' AS i", "0 AS v", "1 AS list", "2 AS score")


def brute(x, k):
    s = x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    np.fill_diagonal(s, -np.inf)
    return [set(np.lexsort((np.arange(len(x)), -r))[:k]) for r in s]


@pytest.mark.parametrize("dims", [1, 3, 16, 33])
def test_recall(spark, dims):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, dims))
    df = frame(spark, x)
    index = V.build_index(df, "id", "vec")
    probes, recall = V.measure_recall(index, 5, 0.9, 2)
    assert recall >= 0.9 and 2 <= probes <= len(index.book.lists)
    got = V.search_index(index, df, "id", "vec", 5, probes).toPandas()
    want = brute(x, 5)
    found = sum(len(want[a] & set(g.b)) for a, g in got.groupby("a"))
    assert found / (5 * len(x)) >= 0.85 and (got.groupby("a").size() == 5).all()
    whole = V.search_index(index, df.where("id < 40"), "id", "vec", 5, len(index.book.lists), 600).toPandas()
    assert all(want[a] == set(g.b) for a, g in whole.groupby("a")) and whole.a.nunique() == 40  # all lists, all reranked: exact


def test_blocks_and_repeats(spark, monkeypatch):
    """A list that holds nearly all rows, and is probed by all queries, is cut on both sides without losing a row."""
    monkeypatch.setattr(V, "ROWS", 50)
    monkeypatch.setattr(V, "QUERIES", 30)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.05 + 1, rng.normal(size=(20, 8))])
    df = frame(spark, x)
    index = V.build_index(df.union(df.limit(50)), "id", "vec", lists=3)
    assert index.rows.count() == 320
    got = V.search_index(index, df, "id", "vec", 3, 3, 320).toPandas()
    want = brute(x, 3)
    assert all(want[a] == set(g.b) for a, g in got.groupby("a")) and got.a.nunique() == 320


def test_odd_rows(spark):
    x = np.eye(4)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(10, None), (11, []), (12, [1.0, float("nan"), 0.0, 0.0]), (13, [1.0, None, 0.0, 0.0]), (14, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0]), (15, [1.0, 0.0, 0.0, 0.0]), (15, [1.0, 0.0, 0.0, 0.0]), (16, [0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    index = V.build_index(df, "id", "vec")
    assert {r["i"] for r in index.rows.collect()} == {0, 1, 2, 3, 15, 16}
    got = {(r["a"], r["b"], r["score"]) for r in V.search_index(index, df.where("id in (0, 10, 14)"), "id", "vec", 1, 6).collect()}
    assert got == {(0, 15, 1.0)}
    assert V.build_index(df.limit(0), "id", "vec") is None and V.build_index(df.where("id in (10, 11)"), "id", "vec") is None


def test_score_aware_codes_lower_the_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = V.fit_book(x, 2000, 4)
    plain = V.Book(book.lists, book.centres, 1.0)
    own = book.nearest_lists(x)[:, 0]

    def along(b):
        rest = x - b.lists[own]
        code = b.codes(x, own)
        said = np.stack([b.centres[m][code[:, m]] for m in range(8)], 1).reshape(2000, 16)
        return np.abs(((rest - said) * x).sum(1)).mean()

    book.eta = 8.0
    assert along(book) < 0.7 * along(plain)


def test_embeddings(spark):
    r = queries()["p4_embedding_recall"](spark, "/root/testdata/sf0.01").first()
    assert r["rows"] == 500 and r["recall"] >= 0.9
    got = queries()["p4_embeddings"](spark, "/root/testdata/sf0.01").toPandas()
    assert (got.groupby("vec_id").size() == 3).all() and got.vec_id.nunique() == 25 and (got.neighbour != got.vec_id).all()
