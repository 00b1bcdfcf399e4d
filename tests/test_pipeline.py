"""Parsing rules, features of single atoms, lookups, and the sweep of the residue pipeline against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import chemistry
from voxelmill.plans import catalogue
from voxelmill.sources import files, structures
from tests.test_sweeps import COLUMNS, sites_of


def test_bad_lines_are_left_out(spark):
    good = "ATOM    123  CA  GLY A  12      11.000  -2.500   3.250  1.00 20.00           c "
    lines = [good, good.replace("123", "12x"), good.replace("1.00 ", "1,00 "), good.replace("20.00", "  x  "), good.replace("11.000", "  --  "), good.replace("  12 ", "  1? "), good.replace("ATOM  ", "REMARK"), good[:54]]
    got = structures.parse_atoms(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r["atom_id"], r["element"], r["occupancy"], r["bfactor"]) for r in got] == [(123, "C", 1.0, 20.0), (123, "C", 0.0, 0.0)]


def test_record_line_reads_back(spark):
    df = spark.range(1).select(structures.record_line("HETATM", F.lit(100_007), F.lit("NH1"), F.lit("ARG"), F.lit("B"), F.lit(-5), (F.lit(-123.4567), F.lit(0.0), F.lit(9.9996)), F.lit(0.5), F.lit(12.345), F.lit("N")).alias("line"))
    r = structures.parse_atoms(df).first()
    assert (r["record"], r["atom_id"], r["atom_name"], r["residue_name"], r["chain_id"], r["residue_number"], r["x"], r["z"], r["occupancy"], r["element"]) == ("HETATM", 7, "NH1", "ARG", "B", -5, -123.457, 10.0, 0.5, "N")
    assert structures.heavy_atoms(structures.parse_atoms(df)).count() == 1 and structures.heavy_atoms(structures.parse_atoms(df).withColumn("element", F.lit("H"))).count() == 0


@pytest.mark.parametrize("atom,element,residue,want", [("N", "N", "GLY", "N--"), ("NZ", "N", "LYS", "ND-"), ("OD1", None, "ASP", "O-A"), ("OG", "O", "SER", "ODA"), ("OD1", "O", "SER", "O--"), ("CA", "CA", None, "C--"), ("ZN", "ZN", "ZN", "---")])
def test_atom_features(spark, atom, element, residue, want):
    df = spark.createDataFrame([(atom, element, residue)], "a string, e string, r string")
    r = df.select(*[v.alias(k) for k, v in chemistry.atom_features(F.col("a"), F.col("e"), F.col("r")).items()]).first()
    kind = "".join(x for x in "CON" if r[f"atom{x}"]) or "-"
    assert kind + ("D" if r["hDonorAtoms"] else "-") + ("A" if r["hAcceptorAtoms"] else "-") == want and r["atoms"] == 1


def test_point_features_by_hand(spark):
    """Two atoms at 3 and 6 A weigh 0.5 and 0; the one at 11.3 only counts as protruding; a far point has zeros."""
    atoms = spark.createDataFrame([("p", "NZ", "LYS", "N", 10.0, 3.0, 0.0, 0.0), ("p", "CB", "ALA", "C", 20.0, -6.0, 0.0, 0.0), ("p", "O", "GLY", "O", 5.0, 0.0, 11.3, 0.0)], "g string, atom_name string, residue_name string, element string, bfactor double, x double, y double, z double")
    dim = spark.createDataFrame([("LYS.NZ", -3.0, 1.0, 2.0)], "atomName string, apRawValids double, apRawInvalids double, atomicHydrophobicity double")
    points = spark.createDataFrame([("p", 1, 0.0, 0.0, 0.0), ("p", 2, 500.0, 0.0, 0.0)], "g string, i long, x double, y double, z double")
    rows = {r["i"]: r for r in chemistry.point_features(points, atoms, "g", "i", chemistry.atom_vectors(atoms, dim)).collect()}
    r = rows[1]
    assert (r["atoms"], r["atomDensity"], r["protrusion"], r["bfactor"], r["basic"], r["hDonorAtoms"], r["atomC"], r["apRawValids"], r["vsCation"]) == (2.0, 0.5, 3.0, 5.0, 1.0, 0.5, 0.0, 4.5, 0.5)
    assert all(v == 0 for c, v in rows[2].asDict().items() if c != "i") and len(r) == 36
    signed = chemistry.atom_vectors(atoms, dim, None, 2.0, True).where("atom_name = 'NZ'").first()
    assert signed["apRawValids"] == -9.0


def test_lookups(spark):
    found = spark.createDataFrame([("abcd",), ("a",), (None,)], "t string").select(files.substrings(F.col("t"), 2, 3).alias("s")).collect()
    assert [sorted(r["s"] or []) for r in found] == [["ab", "abc", "bc", "bcd", "cd"], [], []]
    wanted = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "i int, n string")
    existing = spark.createDataFrame([("b/x",), ("a/y",), ("b/y",)], "path string")
    got = files.resolve(wanted, "i", [F.concat(F.lit("a/"), "n"), F.concat(F.lit("b/"), "n")], existing, "path").collect()
    assert {(r["i"], r["path"]) for r in got} == {(1, "b/x"), (2, "a/y"), (3, None)}
    runs = spark.createDataFrame([(k, c) for k, c in enumerate("aabbbaab")], "o long, k string")
    assert {tuple(r) for r in files.last_runs(runs, "k", "o").collect()} == {("a", 5, 6, 2), ("b", 7, 7, 1)}
    lines = spark.createDataFrame([(1, " x "), (2, "# c"), (3, "PARAM.A=1"), (4, ""), (5, "y"), (6, "x")], "n int, line string")
    assert {tuple(r) for r in files.dataset_list(lines, "line", "n").collect()} == {("x", 1), ("y", 5)}


def test_residue_config_sweep_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    residues, pts = [], []
    for protein in "ABC":
        for lump in range(4):
            c = [rng.uniform(-25, 25) for _ in range(3)]
            for k in range(60):
                strong = lump < 2 and k < 8
                xyz = [round(v + rng.gauss(0, 2.5 if strong else 5.0), 3) for v in c]
                n = lump * 100 + k
                residues.append((len(residues) + 1, protein, n, "GLY", xyz, round(rng.uniform(0, 1), 3), round(rng.uniform(0.6, 1), 4) if strong else round(rng.uniform(0, 0.7), 4)))
                for _ in range(2):
                    p = [round(v + rng.gauss(0, 0.7), 3) for v in xyz]
                    pts.append((len(pts) + 1, protein, len(pts), "A", n, "GLY", *p, 0.5, int(lump in (0, 2) and k < 10)))
    spark.createDataFrame(residues, "residue_uid long, protein_key string, res_id int, res_name string, xyz array<double>, rsa double, prob double").write.parquet(f"{tmp_path}/residues.parquet")
    spark.createDataFrame(pts, COLUMNS).write.parquet(f"{tmp_path}/sas_points.parquet")
    got = {(r["radius"], r["least"], r["least_sum"], r["mode"]): r for r in catalogue.queries()["residue_config_sweep"](spark, str(tmp_path)).collect()}
    assert len(got) == 54
    number = {p[0]: p[4] for p in pts}
    sites = {k: [({number[i] for i in ids}, c) for ids, c, _ in v] for k, v in sites_of(pts).items()}
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    checked = 0
    for (radius, least, least_sum, mode), r in got.items():
        pockets = []
        for protein in "ABC":
            own = [x for x in residues if x[1] == protein]
            near = {(a[0], b[0]) for a in own for b in sorted(own, key=lambda b: (far(a[4], b[4]), b[0]))[:16] if a[0] != b[0] and far(a[4], b[4]) <= radius**2}
            cut = np.quantile([x[6] for x in own], 0.95 if mode == "percentile95" else 0.97)
            left = {x[0]: x for x in own if x[5] >= 0.2 and x[6] >= cut}
            found = []
            while left:
                todo, seen = [left.pop(min(left))], []
                while todo:
                    seen.append(x := todo.pop())
                    todo += [left.pop(k) for k in [k for k in left if (x[0], k) in near or (k, x[0]) in near]]
                total = sum(x[6] for x in seen)
                if len(seen) >= least and total >= least_sum:
                    found.append((total, min(x[0] for x in seen), {x[2] for x in seen}, [sum(x[6] * x[4][a] for x in seen) / (total + 1e-8) for a in range(3)]))
            pockets.append((protein, sorted(found, key=lambda f: (-f[0], f[1]))[:5]))
        n, matches, hits = 0, 0, {1: 0, 3: 0}
        for protein, found in pockets:
            n += len(found)
            pairs = sorted((-len(m & s) / len(m | s), rank, at) for rank, (_, _, m, c) in enumerate(found, 1) for at, (s, g) in enumerate(sites.get(protein, [])) if m & s or far(c, g) <= 36)
            used, taken, ranks = set(), set(), []
            for _, rank, at in pairs:
                if rank not in used and at not in taken:
                    used.add(rank), taken.add(at), ranks.append(rank)
            matches += len(ranks)
            for k in hits:
                hits[k] += any(x <= k for x in ranks)
        assert (r["pockets"], r["matches"]) == (n, matches)
        assert (r["recall_at_1"], r["recall_at_3"]) == pytest.approx((hits[1] / len(sites), hits[3] / len(sites)), abs=2e-6)
        checked += n
    assert checked > 10
