"""Queries that failed on large tables: no frame or join grows with a group's square, and results are those of plain Python and of the SQL."""

import random

import pytest
from tests.oracle import connect, same
from voxelmill.operators import spatial
from voxelmill.plans import catalogue, files


def test_closest_numbers_odd_keys(spark, tmp_path):
    samples = [("AB_c", 5), ("ab_C", 9), ("ab_C", -1), (None, 4), ("ab", 4), ("xy_Z", 2**31 - 1), ("xy_Z", -(2**31) + 1), ("no_N", 3), ("ab_C", None)]
    found = [(1, "ab_C", 3), (2, "ab_C", 7), (3, None, 4), (4, "ab_", 8), (5, "xy_Z", 1), (6, "ab_C", None)]
    spark.createDataFrame(samples, "protein_key string, residue_number int").write.parquet(f"{tmp_path}/sample_store.parquet")
    spark.createDataFrame([(i, k, n, [0.0, 0.0, 0.0], 0.5, 0.5) for i, k, n in found], "residue_uid long, protein_key string, res_id int, xyz array<double>, rsa double, prob double").write.parquet(f"{tmp_path}/residues.parquet")
    got = {(r["protein_key"], r["wanted"]): r["taken"] for r in catalogue.queries()["closest_numbers"](spark, str(tmp_path)).collect()}
    assert got == {("ab_C", 5): 3, ("ab_C", 9): 7, ("ab_C", -1): 3, ("ab_", 4): 8, ("xy_Z", 2**31 - 1): 1, ("xy_Z", -(2**31) + 1): 1}


def test_closest_numbers_reads_no_row_again(spark):
    plan = catalogue.queries()["closest_numbers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 14])
def test_closest_in_stretches(spark, stretch):
    rng = random.Random(stretch)
    rows = lambda keys, n, far: [(rng.choice(keys), rng.randint(-far, far)) for _ in range(n)]
    wanted, have = rows("ABCDE", 400, 400) + [("A", 9_000), ("A", -9_000)], rows("ABC", 60, 300) + [("D", 350), ("A", 8_000)]
    table = lambda r: spark.createDataFrame(r, "protein_key string, n int")
    got = {(r["protein_key"], r["wanted"]): r["taken"] for r in files.closest(table(wanted), table(have), stretch).collect()}
    want = {(k, n): min((abs(m - n), m) for p, m in have if p == k)[1] for k, n in wanted if k in "ABCD"}
    assert got == want


def test_surface_occlusion_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    place = lambda far: [rng.uniform(-far, far) for _ in range(3)]
    rows = [(i, rng.choice(["A", "B", None]), 1, place(6.0), 0.5, 0.5) for i in range(160)] + [(200 + i, "C", 1, place(90.0), 0.5, 0.5) for i in range(400)]
    rows += [(i, "A", 1, place(6.0), 0.4, 0.5) for i in range(10)]  # the same residue in another place
    rows += [(i, "B", 1, rows[i][3], 0.3, 0.5) for i in range(20, 30)] + [(None, "A", 1, [0.0, 0.0, 0.0], 0.5, 0.5), (None, "A", 1, [0.5, 0.0, 0.0], 0.5, 0.5)]
    rows += [(700, "D", 1, [1e12, 0.0, 0.0], 0.5, 0.5), (701, "D", 1, [1e12 + 1, 0.0, 0.0], 0.5, 0.5), (702, "D", 1, [float("inf"), 0.0, 0.0], 0.5, 0.5), (703, "D", 1, [-1e300, 0.0, 0.0], 0.5, 0.5), (704, "D", 1, [float("nan"), 0.0, 0.0], 0.5, 0.5)]
    spark.createDataFrame(rows, "residue_uid long, protein_key string, res_id int, xyz array<double>, rsa double, prob double").write.parquet(f"{tmp_path}/residues.parquet")
    same(catalogue.queries()["surface_occlusion"](spark, str(tmp_path)), connect(str(tmp_path)), catalogue.oracle_sql()["surface_occlusion"])


def test_surface_occlusion_makes_no_rows_of_sample_points(spark):
    plan = catalogue.queries()["surface_occlusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_exposure_of_many_radii(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 3.0)  # most spheres reach into other blocks
    rng = random.Random(5)
    rows = [(rng.choice("AB"), i, *[rng.uniform(-8, 8) for _ in range(3)], rng.choice([0.7, 1.5, 1.8, 2.5])) for i in range(300)]
    atoms = spark.createDataFrame(rows, "protein string, owner long, x double, y double, z double, r double")
    want = {r["owner"]: r["count"] for r in spatial.exposed(spatial.sphere_points(atoms, 5.0), atoms, "protein", "owner").groupBy("owner").count().collect()}
    got = spatial.exposure(atoms, "protein", "owner", 5.0, 2.5).collect()
    assert len(got) == 300 and {r["owner"]: r["exposed"] for r in got if r["exposed"]} == want
