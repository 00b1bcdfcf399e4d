"""Operators p1 to p6 and p8 on small tables: brute force, ties, repeats, nulls, empty tables, clashing columns, hot groups."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from voxelmill.llm import cutoffs, group_split, mixing, overlap, spectral, topn, vector_neighbours

NAN = float("nan")
#: Columns whose names the operators use inside.
CLASH = {"g": "a", "i": "b", "s": "c", "r": "d", "x1": "e", "best": "f", "t": "g", "p": "h", "d": "i", "c": "j", "core": "k", "q": "l", "seq": "m", "entry": "n", "size": "o", "split_": "p"}


def clash(df, names):
    from pyspark.sql import functions as F

    for n in names:
        if n.lower() not in {c.lower() for c in df.columns}:
            df = df.withColumn(n, F.lit("noise"))
    return df


# ---------------------------------------------------------------- p1


def brute_top(rows, n):
    once = {}
    for g, i, s, r in rows:
        if g is None or i is None or s is None or s != s:
            continue
        key = (-s, r is None, r or 0, i)
        once[g, i] = min(once.get((g, i), key), key)
    out = {}
    for (g, _), key in once.items():
        out.setdefault(g, []).append(key)
    return {(g, k[3], place + 1) for g, ks in out.items() for place, k in enumerate(sorted(ks)[:n])}


def test_top_n_ties_repeats_nulls(spark):
    random.seed(3)
    rows = [(random.choice(["a", "b", "hot", None]), random.choice([None, *range(40)]), random.choice([None, NAN, 1.0, 2.0, 0.5, -0.0, 0.0]), random.choice([None, 1, 2])) for _ in range(600)]
    rows += [("hot", 7, 9.0, 1)] * 500  # one item repeated for half of all rows
    df = clash(spark.createDataFrame(rows, "gr string, it long, sc double, rk int"), ["g", "i", "s", "r", "best", "place"])
    got = {(r["gr"], r["it"], r["place"]) for r in topn.top_n_per_group(df, "gr", "it", "sc", "rk", 5).collect()}
    assert got == brute_top(rows, 5)


def test_top_n_small_heaps(spark, monkeypatch):
    """Heaps that are merged in many steps, and handed on early, give the same; items may be strings."""
    rng = random.Random(5)
    rows = [(rng.randrange(30), f"i{rng.randrange(200)}", rng.choice([0.5, 1.0, rng.random()]), rng.choice([None, 1, 2])) for _ in range(3000)]
    monkeypatch.setattr(topn, "BATCH", 100)
    monkeypatch.setattr(topn, "HELD", 50)
    import pyarrow as pa

    names = ["g", "i", "s", "r"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + 70]], pa.schema([("g", pa.int64()), ("i", pa.string()), ("s", pa.float64()), ("r", pa.int64())])) for k in range(0, len(rows), 70)]
    heaps = list(topn._build(4, iter(batches)))
    best, place = topn.heap(pa.Table.from_batches(heaps), 4)
    assert {(g, i, p) for g, i, p in zip(best.column("g").to_pylist(), best.column("i").to_pylist(), place.tolist())} == brute_top(rows, 4)
    assert len(heaps) > 3


def test_top_n_has_one_shuffle(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1)], "gr string, it long, sc double, rk int")
    plan = topn.top_n_per_group(df, "gr", "it", "sc", "rk")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_top_n_empty_and_wrong_n(spark):
    df = spark.createDataFrame([], "gr string, it long, sc double, rk int")
    assert topn.top_n_per_group(df, "gr", "it", "sc", "rk").count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, "gr", "it", "sc", "rk", 0)


# ---------------------------------------------------------------- p2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(3)
        at = rng.randrange(len(s)) if s else 0
        if k == 0 and s:
            s[at] = rng.choice("ACDEF")
        elif k == 1:
            s.insert(at, rng.choice("ACDEF"))
        elif s:
            del s[at]
    return "".join(s)


def test_reach_is_the_longest_partner():
    for length in range(1, 400):
        longest = max(m for m in range(length, 2 * length + 3) if m - m // 10 <= length)
        assert overlap._reach(np.array([length]), 10)[0] == longest // 10


@pytest.mark.parametrize("alphabet", ["ACDEF", "AC"])
def test_near_sequences_against_brute_force(spark, alphabet):
    rng = random.Random(5)
    train = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 8, 9, 10, 11, 18, 19, 20, 21, 30, 45, 60]))) for _ in range(60)]
    evaluation = [mutate(rng, s, rng.randrange(0, 8)) for s in train] + [s[:-1] for s in train] + train[:5]
    rows = {}
    for s in train:
        rows.setdefault(s, [False, False])[0] = True
    for s in evaluation:
        if s:
            rows.setdefault(s, [False, False])[1] = True
    texts = spark.createDataFrame([(k, s, a, b) for k, (s, (a, b)) in enumerate(rows.items())], "sid long, seq string, train boolean, eval boolean")
    name = {k: s for k, s in enumerate(rows)}
    got = {(name[r["t"]], name[r["e"]]) for r in overlap.near_sequences(texts).collect()}
    want = {(a, b) for a, fa in rows.items() if fa[0] for b, fb in rows.items() if fb[1] and edits(a, b) <= max(len(a), len(b)) // 10}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(20, 90))
def test_prefixes_of_near_texts_meet(seed, n):
    """Any two texts within their allowed edits share a shingle of both prefixes, at positions within the edits."""
    rng = random.Random(seed)
    a = "".join(rng.choice("ACDEF"[: rng.choice([1, 2, 5])]) for _ in range(n))
    b = a
    while len(b) < 20 or b == a:
        b = mutate(rng, a, rng.randint(1, n // 10))
    allowed = max(len(a), len(b)) // 10
    if edits(a, b) > allowed or min(len(a), len(b)) < 18:
        return
    found = []
    for t in (a, b):
        number, position, code = overlap.shingles([t], 5)
        order = np.lexsort((position, code, code % np.uint64(97)))
        position, code = position[order], code[order]
        m = overlap.prefix(position, code, 5, int(overlap._reach(np.array([len(t)]), 10)[0]))
        found.append({*zip(code[:m].tolist(), position[:m].tolist())})
    assert any(c == d and abs(p - q) <= allowed for c, p in found[0] for d, q in found[1])


def test_classes_and_report(spark):
    long = "ACDEFGHIKLMNPQRSTVWY" * 3
    train = spark.createDataFrame([(1, "1abc_A", long), (2, "2abc", long), (3, "3abc", None), (4, "4abc", "WWWW"), (5, "9zzz", long[:-2])], "row long, pid string, rs string")
    evaluation = spark.createDataFrame([(11, "x", long.lower() + "*"), (12, "1ABC:B", "Y" * 40), (13, "y", long[1:]), (14, None, None), (15, "zz", "wwww"), (16, "zz", "VVVV")], "row long, pid string, rs string").selectExpr("*", "'val' AS split", "if(row = 16, null, ' Lab ') AS src")
    records = overlap.read_records(train, evaluation, "row", "pid", "rs")
    pairs, members = overlap.near_classes(records)
    assert {tuple(r) for r in pairs.collect()} == {(1, 1), (5, 1), (1, 13), (5, 13), (4, 4)}
    assert {(r["class"], r["r"]) for r in members.collect()} == {(1, 1), (1, 2), (1, 11), (5, 5), (12, 12), (13, 13), (4, 4), (4, 15), (16, 16)}
    named = overlap.entry_classes(records)
    assert {tuple(r) for r in named[0].collect()} == {("1abc", "1abc")}
    hits = overlap.overlapping(pairs, members).union(overlap.overlapping(*named))
    report = {(r["source"], r["records"], r["overlapping"]) for r in overlap.overlap_report(hits, evaluation, "row", "split", "src").collect()}
    assert report == {("lab", 5, 4), (None, 1, 0)}


def test_cross_split_pairs(spark):
    long = "ACDEFGHIKL" * 8
    train = [(1, "sets/x/1abc_A.pdb", long), (2, "PDB_0000ZZZ9_B.cif.gz", None), (3, None, "  " + long.lower()[:40] + "\n" + long[40:] + "*"), (4, "no entry", ""), (5, None, None), (6, "a.001.001.001_4towi1qdb.pdb", "* *")]
    evaluation = [(10, "pdb1ABC.ent.gz", "WWWW"), (11, "zzz9:C", None), (12, "unknown thing", long[:-4]), (13, None, None), (14, "no entry", ""), (15, "D:\\store\\4TOWI1QD.pdb", None)]
    kind = "row long, pid string, rs string"
    t, e = (clash(spark.createDataFrame(x, kind), ["r", "entry", "seq", "train", "sid"]) for x in (train, evaluation))
    got = {tuple(r) for r in overlap.cross_split_pairs(t, e, "row", "pid", "rs").collect()}
    assert got == {(1, 10), (2, 11), (1, 12), (3, 12), (6, 15)}
    assert overlap.cross_split_pairs(t.limit(0), e, "row", "pid", "rs").count() == 0
    assert overlap.cross_split_pairs(t, e.limit(0), "row", "pid", "rs").count() == 0


def test_very_long_sequence(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20000))
    df = spark.createDataFrame([(1, None, base)], "row long, pid string, rs string")
    other = spark.createDataFrame([(2, None, mutate(rng, base, 900)), (3, None, base[:15000])], "row long, pid string, rs string")
    assert [tuple(r) for r in overlap.cross_split_pairs(df, other, "row", "pid", "rs").collect()] == [(1, 2)]


# ---------------------------------------------------------------- p3


def groups_of(n, rows):
    up = {k: k for k in n}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for key in (1, 2):
        seen = {}
        for r in rows:
            if r[key] is not None and r[0] is not None:
                a, b = find(r[0]), find(seen.setdefault(r[key], r[0]))
                up[max(a, b)] = min(a, b)
    return {k: find(k) for k in n}


def test_related_groups_and_forest(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.choice([None, *(f"e{k}" for k in range(200))]), rng.choice([None] * 6 + [f"l{k}" for k in range(40)])) for _ in range(260)] + [(None, "e1", "l1")]
    rows += [(1000 + k, f"chain{k // 2}", f"link{(k + 1) // 2}") for k in range(40)]  # a long path
    df = clash(spark.createDataFrame(rows, "no long, entry string, lab string"), ["id", "root", "key", "a", "b", "u", "v"])
    ids = {r[0] for r in rows if r[0] is not None}
    groups, kept = group_split.related_groups(df, "no", ["entry", "lab"], str(tmp_path / "forest"))
    got = {r["id"]: (r["group_no"], r["size"]) for r in groups.collect()}
    want = groups_of(ids, rows)
    sizes = {}
    for g in want.values():
        sizes[g] = sizes.get(g, 0) + 1
    assert got == {k: (g, sizes[g]) for k, g in want.items()}
    trees, labels = group_split.spanning_forest(group_split.star_edges(df, "no", ["entry", "lab"]))
    nodes, roots = labels.count(), labels.select("root").distinct().count()
    assert trees.select("a", "b").distinct().count() == trees.count() == nodes - roots
    assert spark.read.parquet(str(tmp_path / "forest")).count() == kept.count() == nodes - roots


def test_related_groups_empty(spark):
    df = spark.createDataFrame([], "no long, entry string, lab string")
    assert group_split.related_groups(df, "no", ["entry", "lab"])[0].count() == 0


def test_deal_keeps_groups_and_shares(spark):
    rng = random.Random(4)
    sizes = [(k, rng.choice([1] * 20 + [2, 2, 3, 5, 9, 17])) for k in range(4000)] + [(9000, 2500)]
    df = spark.createDataFrame(sizes, "group_no long, size long")
    dealt = group_split.deal_groups(df, {"train": 0.8, "val": 0.1, "test": 0.1})
    rows = dealt.collect()
    assert len(rows) == len(sizes) == len({r["group_no"] for r in rows})
    total = sum(s for _, s in sizes)
    for name, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert abs(sum(r["size"] for r in rows if r["split"] == name) / total - share) < 0.01
    assert group_split.deal_groups(df.limit(0), {"train": 0.8, "val": 0.2}).count() == 0


def test_split_of_the_table(spark):
    """Every chain of sf0.1 once, groups whole, shares of chains within a thousandth."""
    from voxelmill.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = queries.p3_split(spark, sf).toPandas()
    found = {r["protein_no"]: r["group_no"] for r in queries.p3_found(spark, sf).collect()}
    assert rows.protein_no.is_unique and len(rows) == spark.read.parquet(f"{sf}/proteins.parquet").select("protein_no").distinct().count()
    assert (rows.groupby("group_no").split.nunique() == 1).all()
    assert all(found.get(p, p) == g for p, g in zip(rows.protein_no, rows.group_no))
    share = rows.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.001 and abs(share["val"] - 0.1) < 0.001 and abs(share["test"] - 0.1) < 0.001


# ---------------------------------------------------------------- p4


def brute_knn(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    out = set()
    for a in range(len(x)):
        rest = sorted((d[a, b], b) for b in range(len(x)) if b != a)
        if rest:
            kth = rest[min(k, len(rest)) - 1][0]
            out |= {(a, b) for v, b in rest if v <= kth}
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 900), st.integers(1, 5), st.integers(0, 10_000), st.sampled_from(["even", "grid", "flat", "clumps", "same"]))
def test_search_is_exact(n, k, seed, kind):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * 20
    if kind == "grid":
        x = np.round(x / 5)
    elif kind == "flat":
        x[:, 2] = 0
    elif kind == "clumps":
        x = x * 100 * rng.integers(0, 2, (n, 1)) + rng.normal(size=(n, 3))
    elif kind == "same":
        x = x[rng.integers(0, max(1, n // 10), n)][:120]
    book = vector_neighbours.fit_codebook(np.clip(x.ravel() / (np.abs(x).max() + 1e-9), -1, 1))
    parts, unsure = vector_neighbours.search(x, np.arange(len(x)), k, book)
    assert not unsure
    got = {(int(a), int(b)) for q, r, _ in parts for a, b in zip(q, r)}
    assert got == brute_knn(x, k)


def test_nearest_vectors_nulls_repeats_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows, truth = [], set()
    for g, n in (("small", 40), ("one", 1), ("two", 2), ("big", 900)):
        x = np.round(rng.normal(size=(n, 3)) * (10 if g != "big" else 60), 1)
        if g == "big":
            x[-3:] += 5000  # far from all tiles
        base = len(rows)
        rows += [(g, base + k, *map(float, x[k])) for k in range(n)]
        truth |= {tuple(sorted((base + a, base + b))) for a, b in brute_knn(x, 3)}
    extra = [rows[5], rows[80], rows[500], ("small", 10**6, None, 1.0, 1.0), ("small", 10**6 + 1, NAN, 1.0, 1.0), (None, 10**6 + 2, 1.0, 1.0, 1.0), ("small", None, 1.0, 1.0, 1.0), ("big", 10**6 + 3, float("inf"), 0.0, 0.0)]
    df = clash(spark.createDataFrame(rows + extra, "k string, pt long, x double, y double, z double"), ["g", "i", "v0", "core", "d", "side", "a", "b", "q"])
    for whole, named in ((10**6, 200), (60, 200), (60, 0)):  # as wholes; in tiles, by constants and by joins
        monkeypatch.setattr(vector_neighbours, "NAMED", named)
        got = {(r["a"], r["b"]) for r in vector_neighbours.nearest_vectors(df, "k", "pt", ["x", "y", "z"], 3, paired=True, whole=whole).collect()}
        assert got == truth
    assert vector_neighbours.nearest_vectors(df.limit(0), "k", "pt", ["x", "y", "z"]).count() == 0


def test_directed_neighbours(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 3)) * 9, 1)
    df = spark.createDataFrame([("g", k, *map(float, v)) for k, v in enumerate(x)], "k string, pt long, x double, y double, z double")
    got = {(r["a"], r["b"]) for r in vector_neighbours.nearest_vectors(df, "k", "pt", ["x", "y", "z"], 2, whole=50).collect()}
    assert got == brute_knn(x, 2)


# ---------------------------------------------------------------- p5


@pytest.mark.parametrize("finish", [1, 8, 4096])
def test_cutoffs(spark, finish):
    rng = random.Random(6)
    rows = [(k, rng.choice([" A", "a ", "B", "c", None]), rng.choice([None, NAN, -0.5, 1.5, 0.0, 1.0, round(rng.random(), 2), rng.random()])) for k in range(3000)]
    rows += [(10**6 + k, "tied", 0.25) for k in range(2000)] + rows[:200]
    targets = [("A ", 0.1), ("b", 0.0), ("TIED", 0.5), ("nobody", 0.3), ("none", None), (None, 0.2)]
    df = clash(spark.createDataFrame(rows, "uid long, src string, pr double"), ["t", "i", "p", "source", "n", "k", "cutoff"])
    report, kept = cutoffs.cutoffs(df, "src", "uid", "pr", spark.createDataFrame(targets, "s string, w double"), "s", "w", finish)
    want, cuts = set(), {}
    for name, share in (("a", 0.1), ("b", 0.0), ("tied", 0.5)):
        own = {u: p for u, s, p in rows if s is not None and s.strip().lower() == name and p is not None and 0 <= p <= 1}
        k = max(1, math.floor(len(own) * share))
        cut = sorted(own.values(), reverse=True)[k - 1]
        cuts[name] = (len(own), k, cut, sum(p >= cut for p in own.values()))
        want |= {(name, u) for u, p in own.items() if p >= cut}
    assert {(r["src"], r["uid"]) for r in kept.collect()} == want
    assert {r["source"]: (r["n"], r["k"], r["cutoff"], r["kept"]) for r in report.collect()} == cuts


def test_an_item_of_two_sources_keeps_its_scores_apart(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9), (1, "A ", 0.05), (2, "b", 0.3)], "uid long, src string, pr double")
    report, kept = cutoffs.cutoffs(df, "src", "uid", "pr", spark.createDataFrame([("a", 1.0), ("b", 1.0)], "s string, w double"), "s", "w")
    assert {tuple(r) for r in kept.collect()} == {("a", 1, 0.1), ("b", 1, 0.9), ("b", 2, 0.3)}
    assert {(r["source"], r["n"], r["cutoff"]) for r in report.collect()} == {("a", 1, 0.1), ("b", 2, 0.3)}


def test_cutoffs_empty(spark):
    df = spark.createDataFrame([], "uid long, src string, pr double")
    targets = spark.createDataFrame([("a", 0.5)], "s string, w double")
    report, kept = cutoffs.cutoffs(df, "src", "uid", "pr", targets, "s", "w")
    assert report.count() == kept.count() == 0
    report, kept = cutoffs.cutoffs(df, "src", "uid", "pr", targets.limit(0), "s", "w")
    assert report.count() == kept.count() == 0


# ---------------------------------------------------------------- p6


def brute_sites(rows, radius, least):
    up = {r[1]: r[1] for r in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) <= radius * radius:
                p, q = find(a[1]), find(b[1])
                up[max(p, q)] = min(p, q)
    sites = {}
    for r in rows:
        sites.setdefault(find(r[1]), set()).add(r[1])
    return {(c, p) for c, m in sites.items() if len(m) >= least for p in m}


def test_similarity_clusters(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g, n, w in (("a", 60, 8), ("b", 3, 1), ("c", 200, 25), ("lone", 1, 1)):
        rows += [(g, len(rows) + k, *map(float, np.round(rng.normal(size=3) * w, 2)), 0.9) for k in range(n)]
    base = len(rows)
    rows += [("chain", base + k, 2.9 * k, 0.0, 0.0, 0.95) for k in range(120)]  # a long thin site
    want = brute_sites(rows, 3.0, 3)
    extra = rows[:10] + [("a", 10**6, 0.0, 0.0, 0.0, 0.5), ("a", 10**6 + 1, None, 0.0, 0.0, 0.9), ("a", 10**6 + 2, NAN, 0.0, 0.0, 0.9), ("a", 10**6 + 3, 0.0, 0.0, 0.0, NAN), ("a", 10**6 + 4, 0.0, 0.0, 0.0, None), (None, 10**6 + 5, 0.0, 0.0, 0.0, 0.9)]
    df = clash(spark.createDataFrame(rows + extra, "k string, pt long, x double, y double, z double, pr double"), ["g", "i", "c", "inner", "size", "core", "node"])
    plain = spectral.similarity_clusters(df, "k", "pt", ["x", "y", "z"], "pr", 0.88, 3.0, 3)
    assert {(r["cluster_id"], r["pt"]) for r in plain.collect()} == want
    tiled = spectral.similarity_clusters(df, "k", "pt", ["x", "y", "z"], "pr", 0.88, 3.0, 3, whole=50)
    assert {(r["cluster_id"], r["pt"]) for r in tiled.collect()} == want
    a = {r["pt"]: round(r["affinity"], 9) for r in plain.collect()}
    assert a == {r["pt"]: round(r["affinity"], 9) for r in tiled.collect()}
    told = spectral.describe_clusters(plain, "k", "pt", 2).collect()
    assert len(told) == len({c for c, _ in want}) and all(len(r["typical"]) == 2 for r in told)
    assert spectral.similarity_clusters(df.limit(0), "k", "pt", ["x", "y", "z"], "pr").count() == 0


def test_clusters_come_from_the_vectors(monkeypatch):
    """With noise in place of the iterated vectors there are no clusters to be had, in groups as in blocks of tiles."""
    x = np.stack([np.arange(40) * 1.5, np.zeros(40), np.zeros(40)], 1)
    node, i, j, w, _ = spectral.affinities(x, np.zeros(40, np.int64), 3.0)
    n = int(node.max()) + 1
    assert len(set(spectral.cluster(n, i, j, w, np.zeros(n, np.int64)))) == 1
    monkeypatch.setattr(spectral, "embed", lambda n, i, j, w, seed=5: np.random.default_rng(seed).random((n, spectral.VECTORS)))
    with pytest.raises(ArithmeticError):
        spectral.cluster(n, i, j, w, np.zeros(n, np.int64))
    monkeypatch.setattr(spectral, "embed", lambda n, i, j, w, seed=5: np.ones((n, spectral.VECTORS)))
    assert len(set(spectral.cluster(n, i[:0], j[:0], w[:0], np.zeros(n, np.int64)))) == 1  # vectors that don't differ can't part clusters


def test_lloyd_rounds_move_members():
    """From seeds at gaps, members go to the nearest centre of their group until none moves."""
    v = np.zeros((6, spectral.VECTORS))
    v[:, 0] = [0.0, 0.1, 0.2, 0.9, 1.0, 0.15]
    group = np.array([0, 0, 0, 0, 0, 1])
    label = spectral.k_means(v, group)
    assert len(set(label)) == 6
    spread = np.concatenate([np.linspace(0, 1, 5) * 1e-7, 0.5 + np.linspace(0, 1, 5) * 1e-7])
    v = np.stack([spread] * spectral.VECTORS, 1)
    label = spectral.k_means(v, np.zeros(10, np.int64))
    assert len(set(label[:5])) == len(set(label[5:])) == 1 and label[0] != label[9]


def test_crowds_cost_no_memory_for_pairs(monkeypatch):
    """Points of one place are one node, and their pairs come in blocks; affinities are exact."""
    from voxelmill.operators import kernels

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(400, 3)) * 0.3, rng.normal(size=(400, 3)) * 0.3 + [2.9, 0, 0], [[40.0, 0, 0]]])
    monkeypatch.setattr(kernels, "PAIRS", 500)
    monkeypatch.setattr(spectral, "PAIRS", 50)
    group = np.zeros(len(x), np.int64)
    node, i, j, w, total = spectral.affinities(x, group, 3.0)
    assert node.max() < 60 and len(i) < 400
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = np.where(d2 <= 9, np.exp(-d2 / 18), 0).sum(1) - 1
    assert np.allclose(total, want)
    label = spectral.cluster(int(node.max()) + 1, i, j, w, np.zeros(node.max() + 1, np.int64))[node]
    assert len(set(label[:800])) == 1 and label[800] != label[0]


def test_typical_members_have_the_largest_affinity(spark):
    rows = [("g", 1, 0.0, 0.0, 0.0, 0.9), ("g", 2, 2.0, 0.0, 0.0, 0.9), ("g", 3, 4.0, 0.0, 0.0, 0.9), ("g", 4, 6.0, 0.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "k string, pt long, x double, y double, z double, pr double")
    told = spectral.describe_clusters(spectral.similarity_clusters(df, "k", "pt", ["x", "y", "z"], "pr"), "k", "pt", 2).first()
    assert (told["size"], told["typical"]) == (4, [2, 3])


# ---------------------------------------------------------------- p8


def test_split_counts_are_exact():
    for counts, shards in (([7, 0, 30, 1], 8), ([1], 5), ([0, 0], 3), ([1000, 1], 7)):
        out = mixing.split_counts(np.array(counts), shards, 1)
        assert out.sum(0).tolist() == counts and out.min() >= 0
        assert out.sum(1).max() - out.sum(1).min() <= np.ceil(np.log2(shards)) + 1


def test_branches_grown_in_tasks_are_those_of_the_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BRANCHES", 5)
    counts = np.array([7, 0, 30, 1, 200])
    want = mixing.split_counts(counts, 37, 4)
    rows = mixing.shard_runs(spark, counts, 37, 4).collect()
    got = np.zeros_like(want)
    for r in rows:
        got[r["shard"], r["k"]] = r["high"] - r["low"]
    assert (got == want).all()
    for k in range(5):  # runs of a source follow each other and leave nothing out
        runs = sorted((r["low"], r["high"]) for r in rows if r["k"] == k)
        assert [a for a, _ in runs] == [0, *[b for _, b in runs]][:-1] or not runs
        assert (runs[-1][1] if runs else 0) == counts[k]


def test_sizes_fill_up():
    t = {"a": 1000, "b": 10, "c": 50, "d": 0}
    w = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1), "d": (0.4, 9)}
    assert mixing.plan_sizes(t, w, None) == pytest.approx({"a": 100 / 3, "b": 20, "c": 40 / 3})
    assert mixing.plan_sizes(t, w, 170) == pytest.approx({"b": 20, "a": 150 * 5 / 7, "c": 150 * 2 / 7})
    assert mixing.plan_sizes(t, w, 10**6) == {"a": 1000, "b": 20, "c": 50}
    assert mixing.plan_sizes({}, w, None) == {}


def test_mix_sources(spark):
    rng = random.Random(3)
    words = ["pocket", "cavity", "residue", "the", "of", "site", "chain"]
    docs = []
    for s, n in (("big one", 300), ("Small_One ", 30), ("mid", 120)):
        docs += [(len(docs) + k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) + f" {s}{k}", s) for k in range(n)]
    docs += [(10**6, docs[0][1], "big_one"), (10**6 + 1, None, "mid"), (10**6 + 2, "", "mid"), (10**6 + 3, "text", None), (10**6 + 4, "other", "no target"), (10**6 + 5, docs[5][1], "mid"), docs[7]]
    targets = [("BIG ONE", 0.5, 1), ("small one", 0.3, 3), ("mid", 0.2, 2), ("absent", 0.1, 4), ("bad", None, 1)]
    df = clash(spark.createDataFrame(docs, "id long, body string, src string"), ["i", "x", "source", "tokens", "k", "h", "shard", "copy"])
    mix, report = mixing.mix_sources(df, "id", "body", "src", spark.createDataFrame(targets, "s string, w double, r int"), "s", "w", "r", shards=4, block_tokens=64, total=None)
    rows, told = mix.collect(), {r["source"]: r for r in report.collect()}
    assert set(told) == {"big_one", "small_one", "mid", "absent"}
    assert told["absent"]["share"] == 0
    for s, share in (("big_one", 0.5), ("small_one", 0.3), ("mid", 0.2)):
        assert abs(told[s]["share"] - share) < 0.02
        assert told[s]["taken"] == sum(r["tokens"] for r in rows if r["source"] == s)
    uses = {}
    text = {d[0]: d[1] for d in docs}
    for r in rows:
        uses.setdefault(text[r["id"]], []).append(r["copy"])
    caps = {"big_one": 1, "small_one": 3, "mid": 2}
    source = {r["id"]: r["source"] for r in rows}
    assert all(len(set(c)) == len(c) for c in uses.values())
    assert all(len([r for r in rows if text[r["id"]] == text[i]]) <= caps[source[i]] for i in list(source)[:60])
    assert {r["shard"] for r in rows} == {0, 1, 2, 3}
    assert {(r["shard"], r["place"]) for r in rows} == {(s, p + 1) for s in range(4) for p in range(sum(r["shard"] == s for r in rows))}
    again = mixing.mix_sources(df, "id", "body", "src", spark.createDataFrame(targets, "s string, w double, r int"), "s", "w", "r", shards=4, block_tokens=64, total=None)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mix_fixed_total_reports_shortfall(spark):
    df = spark.createDataFrame([(k, f"text number {k}", "a" if k < 40 else "b") for k in range(44)], "id long, body string, src string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "s string, w double, r int")
    report = {r["source"]: r for r in mixing.mix_sources(df, "id", "body", "src", targets, "s", "w", "r", total=100)[1].collect()}
    assert report["b"]["taken"] == 2 * report["b"]["available"] and report["b"]["share"] < 0.5


def test_corpus_mix_on_the_table(spark):
    """Shares of the whole mix at sf0.01 against sizes by another encoder: each source within half its largest text of what its weight or its repeats allow."""
    import base64
    import tiktoken
    from voxelmill.llm import bpe, queries
    from voxelmill.functions.keys import tidy
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    judge = tiktoken.Encoding("judge", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", tidy(F.col("source")).alias("s")).orderBy("doc_id").collect():
        if r["text"] and r["s"]:
            texts.setdefault(r["text"], (r["doc_id"], r["s"]))
    goal = {r["s"]: (r["target_weight"], r["max_repeats"]) for r in spark.read.parquet(f"{sf}/mix_targets.parquet").select("*", tidy(F.col("source")).alias("s")).collect()}
    size = {i: (s, len(judge(t))) for t, (i, s) in texts.items() if s in goal}
    have = {s: sum(n for q, n in size.values() if q == s) for s in goal}
    want = mixing.plan_sizes(have, goal, sum(have.values()))
    report = {r["source"]: r for r in queries.p8_shares(spark, sf).collect()}
    rows = queries.p8_mix(spark, sf).collect()
    for s in goal:
        largest = max([n for q, n in size.values() if q == s], default=0)
        assert report[s]["available"] == have[s] and abs(report[s]["taken"] - want.get(s, 0)) <= largest / 2 + 1
        assert report[s]["taken"] == sum(r["tokens"] for r in rows if r["source"] == s)
        assert report[s]["share"] + report[s]["shortfall"] >= goal[s][0] / sum(w for w, _ in goal.values()) - 1e-9
    uses = {}
    for r in rows:
        assert size[r["doc_id"]] == (r["source"], r["tokens"])
        uses.setdefault(r["doc_id"], set()).add(r["copy"])
    assert len(rows) == sum(map(len, uses.values())) and all(c == set(range(len(c))) and len(c) <= goal[size[i][0]][1] for i, c in uses.items())
    assert sum(r["tokens"] for r in rows) > 0.95 * sum(have.values())


def test_mix_empty(spark):
    df = spark.createDataFrame([], "id long, body string, src string")
    targets = spark.createDataFrame([("a", 0.5, 1)], "s string, w double, r int")
    mix, report = mixing.mix_sources(df, "id", "body", "src", targets, "s", "w", "r")
    assert mix.count() == 0 and report.count() == 1
    mix, report = mixing.mix_sources(df, "id", "body", "src", targets.limit(0), "s", "w", "r")
    assert mix.count() == 0 and report.count() == 0
