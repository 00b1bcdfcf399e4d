"""Hand-checkable cases of the core's operators."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voxelmill.functions import chemistry, expressions as X
from voxelmill.functions.keys import entry_code, tidy
from voxelmill.operators import graph, kernels, metrics, sampling, spatial
from voxelmill.operators.grouped import map_groups
from voxelmill.sources import files, sinks, structures
from voxelmill.storage import materialize


def line(spark, xs, group="g"):
    return spark.createDataFrame([(group, k, float(x), 0.0, 0.0) for k, x in enumerate(xs)], "protein string, id long, x double, y double, z double")


# ------------------------------------------------------------- keys and numbers


@pytest.mark.parametrize("name,entry", [
    ("1n2z_A.pdb", "1n2z"), ("a.001.001.001_1s69a.pdb", "1s69"), ("PDB_8RMKMFJ0_A.cif.gz", "8rmkmfj0"), ("pdb7uhhivjl.ent.gz", "7uhhivjl"), ("D:\\store\\membra\\0B24.pdb", "0b24"),
    ("sets/holoset/07mb_B.pdb", "07mb"), ("  3v9zrl6e_A.pdb ", "3v9zrl6e"), ("91gevsjb:A", "91gevsjb"), ("2ob2eo6o-C", "2ob2eo6o"), ("pdb_00000106.cif", "0106"), ("0106_A", "0106"),
    ("d.054.001.005_2youzwkta.pdb", "2youzwkt"), ("pdb0v6g.ent.gz", "0v6g"), ("", None), (None, None), ("toolongname", None), ("ab", None), ("e.017.003.006_0hohb.pdb", "0hoh"),
])
def test_entry_code(spark, name, entry):
    assert spark.createDataFrame([(name,)], "n string").select(entry_code(F.col("n"))).first()[0] == entry


def test_key_expressions(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "n string").select(f(F.col("n"))).first()[0]
    assert one("1n2z_A.pdb", lambda c: X.strip_chain(X.stem(c))) == "1n2z"
    assert one("a.001.001.001_1s69a.pdb", lambda c: X.strip_chain(X.stem(c))) == "a.001.001.001_1s69a"
    assert one("1a4j_H", X.pdb4_strict) == "1a4j"
    assert one("a.001.001.001_1s69a_A", X.pdb4_strict) is None
    assert one("a.001.001.001_1s69a_A", X.pdb4_loose) is None
    assert one("3iyt_a_A", X.repair_embedding_name) == "3iyt_A"
    assert one("3iyt_b_A", X.repair_embedding_name) == "3iyt_b_A"
    assert one("1ABC:A:12", X.key_of_residue_id) == "1abc_A"
    assert one(" Lab  Notes_", tidy) == "lab_notes"
    assert one("60/40", X.parse_ratio) == [0.6, 0.4]
    assert one("3:2", X.parse_ratio) == pytest.approx([0.6, 0.4]) and one("0.2, 0.6", X.parse_ratio) == pytest.approx([0.25, 0.75])
    assert X.parse_thresholds("auto")[0] == 0.1 and len(X.parse_thresholds("auto")) == 17 and X.parse_thresholds("0.3,0.5") == [0.3, 0.5]


def test_numbers(spark):
    rows = spark.createDataFrame([("",), (None,), ("x",), ("NaN",), ("Infinity",), ("-Infinity",), ("3.7",), ("-3.7",)], "t string")
    assert [r[0] for r in rows.select(X.safe_double(F.col("t"))).collect()] == [0.0, 0.0, 0.0, 0.0, 1.0, -1.0, 3.7, -3.7]
    assert [r[0] for r in rows.select(X.int_of_text(F.col("t"))).collect()] == [-1, -1, -1, -1, -1, -1, 3, -3]
    w = spark.range(1).select(*[X.neighbour_weights(F.array(F.lit(1.0), F.lit(3.0)), m).alias(m) for m in ("softmax", "inverse", "uniform")]).first()
    assert w["softmax"] == pytest.approx([1 / (1 + math.exp(-1)), 1 - 1 / (1 + math.exp(-1))])
    assert w["inverse"] == pytest.approx([0.75, 0.25], abs=1e-6) and w["uniform"] == [0.5, 0.5]
    with pytest.raises(ValueError):
        X.neighbour_weights(F.array(F.lit(1.0)), "other")
    h = spark.range(1).select(X.histogram_probability(F.lit(99.0), 0.0, 3.0, [0, 1, 3], [5, 6, 9]).alias("last"), X.histogram_probability(F.lit(0.5), 0.0, 3.0, [0, 2, 3], [4, 6, 9]).alias("mid")).first()
    assert h["last"] == 0.25 and h["mid"] == pytest.approx(1 / 6)


# --------------------------------------------------------------------- spatial


def test_single_linkage_and_growth(spark):
    points = line(spark, [0, 3, 6, 10])
    got = graph.density_clusters(points, "protein", "id", 3.0, 1, 3)
    assert {(r["id"], r["cluster_id"]) for r in got.collect()} == {(0, 0), (1, 0), (2, 0)}
    every = line(spark, [0, 3, 6, 9.5, 9.6])
    core = every.where("id < 3").withColumn("cluster_id", F.lit(0))
    assert {r["id"] for r in spatial.grow(core, every, "protein", "cluster_id", "id", 3.5).collect()} == {0, 1, 2, 3}
    twice = line(spark, [0, 0, 1])
    assert {r["id"] for r in spatial.grow(twice.where("id = 0").withColumn("cluster_id", F.lit(0)), twice, "protein", "cluster_id", "id", 0).collect()} == {0, 1}


def test_dbscan_noise(spark):
    five = spark.createDataFrame([("g", 0, 0.0, 0.0, 0.0), ("g", 1, 2.9, 0.0, 0.0), ("g", 2, -2.9, 0.0, 0.0), ("g", 3, 0.0, 2.9, 0.0), ("g", 4, 0.0, -2.9, 0.0)], "protein string, id long, x double, y double, z double")
    assert graph.density_clusters(five, "protein", "id", 3.0, 5).count() == 5
    assert graph.density_clusters(five.where("id < 4"), "protein", "id", 3.0, 5).count() == 0


def test_knn(spark):
    rows = spark.createDataFrame([("g", n, float(x), 0.0, 0.0) for n, x in ((1, 0), (2, 1), (3, 3), (4, 7))], "protein string, id long, x double, y double, z double")
    near = spatial.knn_join(rows.where("id = 1"), rows.withColumnRenamed("id", "o"), "protein", "id", "o", 3, 0.5, F.col("id") != F.col("_item"))
    assert [(r["o"], r["d2"]) for r in near.orderBy("rank").collect()] == [(2, 1.0), (3, 9.0), (4, 49.0)]


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 120), st.integers(0, 999), st.floats(0.5, 40))
def test_radius_kernel(n, seed, radius):
    rng = np.random.default_rng(seed)
    x, g = rng.normal(size=(n, 3)) * 20, rng.integers(0, 3, n)
    i, j, _ = kernels.radius_pairs(x, g, radius)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if g[a] == g[b] and d2[a, b] <= radius * radius * (1 + 1e-12)}
    assert {*zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_quantiles_by_ranges(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.5, -3.0, None])) for g in "abc" for _ in range(rng.choice([1, 50, 400]))] + [("one", 7.0), ("flat", 2.0), ("flat", 2.0), ("none", None), ("ends", float("inf")), ("ends", float("-inf")), ("ends", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in metrics.quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "top": 1.0}).collect()}
    for g in {r[0] for r in rows} - {"ends"}:
        own = [v for k, v in rows if k == g and v is not None]
        if not own:
            assert g not in got
            continue
        assert got[g]["n"] == len(own)
        assert [got[g][c] for c in ("q1", "m", "top")] == pytest.approx(list(np.quantile(own, [0.25, 0.5, 1.0])), abs=1e-12)
    assert got["ends"]["m"] == 1.0 and got["ends"]["top"] == float("inf")
    wanted = df.select("g").distinct().selectExpr("g", "'k' AS name", "0L AS at")
    least = {r["g"]: r["value"] for r in metrics.order_statistics(df, ["g"], "v", wanted, 7).collect()}
    assert least == {g: min(v for k, v in rows if k == g and v is not None) for g in {k for k, v in rows if v is not None}}


@pytest.mark.parametrize("spread", ["left", "right"])
def test_radius_join_spreads_either_side(spark, spread):
    rng = random.Random(7)
    make = lambda n, name: spark.createDataFrame([(rng.choice("ab"), k, *(rng.uniform(-6, 6) for _ in range(3))) for k in range(n)], f"g string, {name} long, x double, y double, z double")
    left, right = make(60, "l"), make(80, "r")
    got = {(r["l"], r["r"]) for r in spatial.radius_join(left, right, "g", 2.5, None, spread).collect()}
    dist = lambda p, q: sum((p[c] - q[c]) ** 2 for c in "xyz")
    want = {(p["l"], q["r"]) for p in left.collect() for q in right.collect() if p["g"] == q["g"] and dist(p, q) <= 6.25}
    assert got == want
    pairs = spatial.radius_pairs(left, "g", "l", 2.5).collect()
    rows = left.collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == sorted((p["l"], q["l"]) for p in rows for q in rows if p["l"] < q["l"] and p["g"] == q["g"] and dist(p, q) <= 6.25)


def test_radius_kernel_in_small_blocks():
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(300, 3)) * 4, rng.integers(0, 2, 300)
    whole = kernels.radius_pairs(x, g, 2.0)
    blocks = list(kernels.radius_pair_blocks(x, g, 2.0, 16))
    assert len(blocks) > 50 and all(len(b[0]) <= 16 for b in blocks)
    assert {*zip(*(np.concatenate(v).tolist() for v in zip(*blocks)))} == {*zip(*(v.tolist() for v in whole))}
    assert kernels.number(np.array([5, 5, 1, 1]), np.array([2.0, 1.0, 2.0, 2.0])).tolist() == [2, 1, 0, 0]


@pytest.mark.parametrize("samples", [1, 3])
def test_clusters_by_edges_equal_those_by_kernel(spark, samples):
    rng = random.Random(4)
    df = spark.createDataFrame([("g" if k % 3 else "h", k, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 8)) for k in range(400)], "protein string, id long, x double, y double, z double")
    kernel = graph.density_clusters(df, "protein", "id", 2.5, samples)
    edges = graph.density_clusters(df, "protein", "id", 2.5, samples, whole=10)
    assert sorted(map(tuple, kernel.collect())) == sorted(map(tuple, edges.collect()))


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500)]
    up = {}

    def find(k):
        up.setdefault(k, k)
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in up}


@pytest.mark.parametrize("whole", [10**6, 20])
def test_group_components(spark, whole):
    rng = random.Random(6)
    rows = [(f"g{k}", 100 * k + rng.randrange(100), 100 * k + rng.randrange(100)) for k in range(4) for _ in range(15 if k else 70)]
    df = spark.createDataFrame(rows, "p string, a long, b long")
    want = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    assert {r["id"]: r["component"] for r in graph.group_components(df, "p", whole).collect()} == want


def test_suppression(spark):
    items = spark.createDataFrame([(0, 3.0, 0.0), (1, 2.0, 6.0), (2, 1.0, 13.0)], "id long, score double, x double")
    pairs = items.alias("p").join(items.alias("q"), F.col("p.id") < F.col("q.id")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.abs(F.col("p.x") - F.col("q.x")).alias("d"))
    kept = lambda cond: {r["id"] for r in graph.greedy_suppression(items, "id", [-F.col("score")], pairs.where(cond)).collect()}
    assert kept("d < 6") == {0, 1, 2} and kept("d <= 6") == {0, 2}


def test_suppression_is_greedy(spark):
    rng = random.Random(2)
    score = {k: rng.choice([1.0, 2.0, 3.0]) for k in range(60)}
    edges = {(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.08}
    kept = []
    for k in sorted(score, key=lambda k: (-score[k], k)):
        if not any((min(k, o), max(k, o)) in edges for o in kept):
            kept.append(k)
    got = graph.greedy_suppression(spark.createDataFrame(list(score.items()), "id long, score double"), "id", [-F.col("score")], spark.createDataFrame(list(edges), "a long, b long"))
    assert {r["id"] for r in got.collect()} == set(kept)


def test_matching_is_greedy(spark):
    rng = random.Random(3)
    pairs = [(a, 100 + b, rng.choice([0.1, 0.5, 0.9])) for a in range(12) for b in range(12) if rng.random() < 0.4]
    left, right, want = set(), set(), set()
    for a, b, v in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    got = graph.greedy_match(spark.createDataFrame(pairs, "l long, r long, v double"), "l", "r", [-F.col("v")])
    assert {(r["l"], r["r"]) for r in got.collect()} == want
    assert graph.greedy_match(spark.createDataFrame([], "l long, r long, v double"), "l", "r", [-F.col("v")]).count() == 0


def test_smoothing_of_a_lone_node(spark):
    nodes, edges = spark.createDataFrame([(1, 0.8)], "i long, v double"), spark.createDataFrame([], "a long, b long")
    value = lambda how: graph.smooth(nodes, "i", "v", edges, 0.7, 1, how).first()["v"]
    assert value("shrink") == pytest.approx(0.56) and value("keep") == 0.8


def test_hull():
    cube = np.array([(a, b, c) for a in (0, 2) for b in (0, 2) for c in (0, 2)], float)
    assert kernels.hull_volume(cube) == pytest.approx(8)
    assert kernels.hull_volume(np.vstack([cube, cube.mean(0), cube[0]])) == pytest.approx(8)
    assert kernels.hull_volume(cube[:3]) is None and kernels.hull_volume(cube[cube[:, 0] == 0]) is None
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert kernels.hull_volume(x[:600]) == pytest.approx(4 / 3 * math.pi, rel=0.05)


def test_occlusion(spark):
    atoms = spark.createDataFrame([("g", 1, 0.0, 0.0, 0.0, 2.0), ("g", 2, 0.0, 0.0, 1.0, 2.0), ("g", 3, 50.0, 0.0, 0.0, 2.0)], "protein string, owner long, x double, y double, z double, r double")
    samples = spatial.sphere_points(atoms, 5.0)
    assert {r["owner"]: r["count"] for r in samples.groupBy("owner").count().collect()} == {1: 20, 2: 20, 3: 20}
    free = {r["owner"]: r["count"] for r in spatial.exposed(samples, atoms, "protein", "owner").groupBy("owner").count().collect()}
    assert free[3] == 20 and free[1] < 20 and free[2] < 20


# --------------------------------------------------------------------- metrics


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "p double, y int")
    counts = {r["t"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in metrics.threshold_counts(df, [0.5, 0.95]).collect()}
    assert counts == {0.5: (2, 1, 0, 1), 0.95: (0, 0, 2, 2)}
    assert {r["t"]: r["tp"] for r in metrics.confusion(metrics.with_thresholds(df, [0.5])).collect()} == {0.5: 2}
    s = metrics.score_steps(df)
    out = s.agg(metrics.average_precision(s).alias("ap"), metrics.auroc(s).alias("auc")).first()
    assert out["ap"] == pytest.approx((0.5 + 2 / 3) / 2) and out["auc"] == pytest.approx(0.625)


def test_percentile_and_kth(spark):
    assert spark.range(11).select(F.expr("percentile(id, 0.95)")).first()[0] == 9.5


# ------------------------------------------------------------ sources and sinks


PDB = """HEADER    TEST
ATOM      1  N   GLY A   1      11.104   6.134  -6.504  1.00 20.50           N
ATOM      2  CA  GLY A   1      11.639   6.071  -5.147
ATOM      3  CA  TYR B   2       1.000   2.000   3.000  0.50
ATOM      x  CA  TYR B   x       1.000   2.000   3.000
HETATM    9  C1  LIG A 301       0.000   0.000   0.000
HETATM   10  C2  LIG A 301       3.000   0.000   0.000
HETATM   11  O1  LIG A 301       0.000   3.000   0.000
HETATM   12  O   HOH A 302       0.000   3.000   0.000
HETATM   13  C1  TWO A 303       0.000   3.000   0.000
"""


def test_structure_text(spark, tmp_path):
    (tmp_path / "1abc.pdb").write_text(PDB)
    atoms = materialize(structures.parse_atoms(structures.read_lines(spark, str(tmp_path))))
    rows = {(r["record"], r["atom_name"], r["residue_number"]): r for r in atoms.collect()}
    assert len(rows) == 8 and rows["ATOM", "N", 1]["bfactor"] == 20.5 and rows["ATOM", "CA", 1]["occupancy"] == 0.0 and rows["ATOM", "CA", 1]["element"] == "C"
    lig = structures.ligands(atoms, ["file"]).collect()
    assert len(lig) == 1 and (lig[0]["residue_name"], lig[0]["atoms"], lig[0]["x"]) == ("LIG", 3, 1.0)
    chain = lambda c: {r["chain_id"] for r in structures.alpha_carbons(atoms, "file", F.lit(c)).collect()}
    assert chain("B") == {"B"} and chain("Z") == {"A"}
    assert {(r["chain_id"], r["sequence"]) for r in structures.sequences(atoms, ["file", "chain_id"]).collect()} == {("A", "G"), ("B", "Y")}


def test_lists_and_settings(spark, tmp_path):
    lines = spark.createDataFrame([("# head",), ("PARAM.x=1",), ("",), (" a.pdb ",), ("a.pdb",), ("b.pdb",)], "line string")
    assert {r[0] for r in files.dataset_list(lines).collect()} == {"a.pdb", "b.pdb"}
    sites = spark.createDataFrame([("# c",), ("1abc 1 A 10",), ("1abc 1 A 11 x",), ("1abc 2 B 5",), ("short 1",)], "line string")
    assert {(r["pocket_id"], len(r["residues"])) for r in files.site_text(sites).collect()} == {(1, 2), (2, 1)}
    names = spark.createDataFrame([("m-auprc=0.31.ckpt",), ("m-auprc=0.42.ckpt",), ("last.ckpt",)], "name string")
    assert files.best_checkpoint(names).first()["name"] == "m-auprc=0.42.ckpt"
    (tmp_path / "p.json").write_text('{"type": "platt", "a": 2.0,\n "b": -1.0}')
    assert files.platt_settings(spark, str(tmp_path / "p.json")) == (2.0, -1.0)
    (tmp_path / "i.json").write_text('{"indices": [3, 5]}')
    assert [r[0] for r in files.index_payload(spark, str(tmp_path / "i.json")).collect()] == [3, 5]
    (tmp_path / "t.csv").write_text("atomName, v\nALA.CA, 1.5\n")
    assert files.property_table(spark, str(tmp_path / "t.csv")).first().asDict() == {"atomName": "ALA.CA", "v": 1.5}
    assert files.newest(spark.createDataFrame([("a", 1), ("b", 3)], "path string, mtime long")).first()[0] == "b"


def test_feature_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,chain_id,class\n1,A,0\n2,,1\n3,B,1\n")
    df = files.feature_csv(spark, str(tmp_path / "a.csv"), "a")
    assert df.count() == 2 and files.has_features(df, ["x", "class"]) and not files.has_features(df, ["nope"])
    assert X.feature_columns(df.columns, ["chain_id", "class", "source_file"]) == ["x"]


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_islands(spark, n):
    rng = random.Random(n)
    keys = [rng.choice(["a", "b", None]) for _ in range(n)]
    got = sorted(((r["island"], r["k"], r["first"], r["last"], r["n"]) for r in files.islands(spark.createDataFrame(list(enumerate(keys)), "o long, k string"), "k", "o").collect()))
    want, at = [], 0
    while at < n:
        end = at
        while end < n and keys[end] == keys[at]:
            end += 1
        want.append((len(want) + 1, keys[at], at, end - 1, end - at))
        at = end
    assert got == want


def test_running_fallback(spark):
    df = spark.createDataFrame([("g", k, None if k % 3 else k) for k in range(30)], "f string, o long, n int")
    a = {r["o"]: r["residue"] for r in sampling.running_fallback(df, ["f"], "o", F.col("n"), width=4).collect()}
    bad = 0
    for k in range(30):
        bad += k % 3 > 0
        assert a[k] == (k if k % 3 == 0 else bad)


def test_pocket_file(spark, tmp_path):
    cols = "file_name string, n_ligands int, n_pockets int, pocket string, ligand string, rank int, score double, new_rank int, old_score double, z_score_tp double, proba_tp double, sample_points int, raw_new_score double, pocket_volume double, surface_atoms int"
    df = spark.createDataFrame([("a.pdb", 1, 2, "pocket1", None, 1, 0.5, 1, 0.25, None, None, 7, 1.0, None, 3)], cols)
    row = sinks.pocket_file(df).first().asDict()
    assert tuple(row) == sinks.POCKET_COLUMNS and row["score"] == "0.500000" and row["zScoreTP"] == "" and row["pocketVolume"] == ""
    sinks.pocket_files(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    assert {r["metric"]: r["value"] for r in sinks.metric_rows(df, ["rank", "score"]).collect()} == {"rank": 1.0, "score": 0.5}
    sinks.sample_store(spark.createDataFrame([("k", 0), ("k", 1)], "protein_key string, split int"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("split = 1").count() == 1
    both = sinks.union_features([df.select("rank", "score"), df.select("rank"), df.select("pocket")], ["rank"])
    assert both.count() == 2
    assert '"rank":1' in sinks.summary_json(df.select("score", "rank")).first()[0]
    view = sinks.view_script(spark.createDataFrame([("p", 2, 1.0, 2.0, 3.0), ("p", 1, 0.0, 0.0, 0.0)], "protein_key string, rank int, cx double, cy double, cz double")).first()["script"]
    assert view.split("\n")[0] == "pseudoatom pocket1, pos=[0.000, 0.000, 0.000]"


def test_chemistry(spark):
    df = spark.createDataFrame([("GLY", "CA"), ("MSE", "SD"), ("HIS", "ND1"), ("XXX", "ZZ"), (None, None), ("CA", "CA"), ("ASP", "OD1")], "residue_name string, atom string")
    rows = chemistry.with_chemistry(df).select("residue_name", "hydropathy", *[v.alias(f"vs_{k}") for k, v in chemistry.atom_flags(F.col("atom"), F.col("residue_name")).items()]).collect()
    by = {r["residue_name"]: r for r in rows}
    assert by["MSE"]["hydropathy"] == 1.9 and by["XXX"]["hydropathy"] == 0 and by["GLY"]["vs_hydrophobic"] == 1 and by["CA"]["vs_hydrophobic"] == 0
    assert by["HIS"]["vs_donor"] == by["HIS"]["vs_acceptor"] == 1 and by["ASP"]["vs_anion"] == 1 and by["XXX"]["vs_cation"] == 0


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    held = sampling.exact_split(df, "k", 0.25, 3).collect()
    assert len(held) == df.select("k").distinct().count() and sum(r["held"] for r in held) == round(0.25 * len(held))
    assert {r["k"] for r in sampling.exact_split(df, "k", 0.25, 4).collect() if r["held"]} != {r["k"] for r in held if r["held"]}
    assert sampling.exact_split(df, "k", 0.25, 3, 1).where("held").count() == sum(r["held"] for r in held)
    assert {r["split"] for r in sampling.hash_split(df, "k", {"a": 0.5, "b": 0.5}).collect()} == {"a", "b"}
    assert sampling.sample(df, "k", 7).count() == 7
    assert sampling.repeat(df.limit(2), F.lit(3)).count() == 6
    leaks = spark.createDataFrame([("e", 0), ("e", 1), ("e", 1), ("f", 0), (None, 1)], "entity string, split int")
    assert [r["entity"] for r in sampling.leaking(leaks, "entity", "split").collect()] == ["e"]
    assert sorted((r["entity"] or "", r["new_split"]) for r in sampling.resolve_leaks(leaks, "entity", "split").collect()) == [("", 1), ("e", 1), ("e", 1), ("e", 1), ("f", 0)]


# ------------------------------------------------------------------ group kernel


def test_groups_reach_the_kernel_whole(spark):
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(5)
        rows = [(rng.choice(["a", "b", "c", None, "d"]), rng.randrange(3), k) for k in range(400)]
        df = spark.createDataFrame(rows, "g string, h int, v long")

        def kernel(table, starts):
            v = table.column("v").to_numpy()
            first = pa.array(starts[:-1])
            return pa.table({"g": table.column("g").take(first), "h": table.column("h").take(first), "s": pa.array([int(v[a:b].sum()) for a, b in zip(starts[:-1], starts[1:])], pa.int64())})

        got = sorted(map(str, map(tuple, map_groups(df, ["g", "h"], kernel, "g string, h int, s long").collect())))
        want = {}
        for g, h, v in rows:
            want[g, h] = want.get((g, h), 0) + v
        assert got == sorted(str((*k, v)) for k, v in want.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
