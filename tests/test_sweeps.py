"""The sweeps over settings and the pocket queries on grown members, against brute force in plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest

from voxelmill.operators import kernels
from voxelmill.plans import catalogue

COLUMNS = "point_id long, protein_key string, point_idx int, chain_id string, residue_number int, residue_name string, x double, y double, z double, prob double, label int"


def made_points(seed=3):
    """Proteins with lumps of strong and labelled points beside weak ones: some sites are missed, some pockets have no site, one protein has neither."""
    rng, rows = random.Random(seed), []
    for protein in "ABCDEF":
        for lump in range(5):
            cx, cy, cz = (round(rng.uniform(-18, 18), 3) for _ in range(3))
            strong, labelled = (rng.random() < 0.7, rng.random() < 0.6) if protein != "F" else (False, False)
            for k in range(rng.randint(4, 14)):
                x, y, z = (round(c + rng.gauss(0, 1.8), 3) for c in (cx, cy, cz))
                prob = round(rng.uniform(0.85, 1.0) if strong and rng.random() < 0.8 else rng.uniform(0, 0.8), 4)
                rows.append((len(rows) + 1, protein, k, "A", lump, "GLY", x, y, z, prob, int(labelled and rng.random() < 0.8)))
    return rows


def written(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/sas_points.parquet")
    return str(folder)


def d2(a, b):
    return sum((p - q) ** 2 for p, q in zip(a[6:9], b[6:9]))


def linked(rows, radius, least):
    """Clusters of single linkage, as lists of rows."""
    left, out = {r[0]: r for r in rows}, []
    while left:
        todo, seen = [left.pop(min(left))], []
        while todo:
            seen.append(r := todo.pop())
            todo += [left.pop(k) for k in [k for k, q in left.items() if q[1] == r[1] and d2(r, q) <= radius * radius]]
        out += [seen] if len(seen) >= least else []
    return out


def centre(rows):
    return [sum(r[k] for r in rows) / len(rows) for k in (6, 7, 8)]


def pockets_of(rows, threshold, radius, least):
    """Ranked pockets of each protein: ``(score, id, members, centre)``."""
    out = defaultdict(list)
    for core in linked([r for r in rows if r[9] >= threshold], radius, least):
        members = {q[0]: q for q in rows if q[1] == core[0][1] and any(d2(q, c) <= 3.5 * 3.5 for c in core)}
        out[core[0][1]].append((sum(q[9] ** 2 for q in members.values()), min(c[0] for c in core), members, centre(core)))
    return {p: sorted(v, key=lambda x: (-round(x[0], 6), x[1])) for p, v in out.items()}


def sites_of(rows):
    out = defaultdict(list)
    for site in linked([r for r in rows if r[10] >= 0.5], 3.0, 3):
        out[site[0][1]].append(({r[0] for r in site}, centre(site), min(r[0] for r in site)))
    return {p: sorted(v, key=lambda x: (-len(x[0]), x[2])) for p, v in out.items()}


def test_config_sweep_against_brute_force(spark, tmp_path):
    rows = made_points()
    got = catalogue.queries()["config_sweep"](spark, written(spark, tmp_path, rows)).collect()
    sites, want = sites_of(rows), {}
    for t in (0.88, 0.91, 0.95):
        for radius in (2.0, 3.0, 4.0):
            for least in (3, 5):
                pockets = pockets_of(rows, t, radius, least)
                hit, ious = {1: 0, 3: 0}, []
                for protein, own in sites.items():
                    pairs = []
                    for rank, (_, _, members, c) in enumerate(pockets.get(protein, []), 1):
                        for at, (site, s, _) in enumerate(own):
                            overlap = len(site & set(members))
                            if overlap or sum((a - b) ** 2 for a, b in zip(c, s)) <= 36:
                                pairs.append((-overlap / len(site | set(members)), rank, at))
                    used, taken, ranks = set(), set(), []
                    for iou, rank, at in sorted(pairs):
                        if rank not in used and at not in taken:
                            used.add(rank), taken.add(at), ranks.append(rank), ious.append(-iou)
                    for k in hit:
                        hit[k] += any(r <= k for r in ranks)
                n = sum(map(len, pockets.values()))
                one, three, iou, precision = hit[1] / len(sites), hit[3] / len(sites), sum(ious) / len(ious) if ious else 0, len(ious) / (n + 1e-8)
                want[t, radius, least] = (n, len(ious), one, three, iou, precision, 0.3 * one + 0.3 * three + 0.2 * iou + 0.2 * precision)
    assert len(got) == len(want) == 18
    for r in got:
        assert tuple(r[c] for c in ("pockets", "matches", "recall_at_1", "recall_at_3", "mean_iou", "precision", "combined")) == pytest.approx(want[r["threshold"], r["radius"], r["least"]], abs=2e-6)
    assert len({w[-1] for w in want.values()}) > 5 and any(0 < w[1] < w[0] for w in want.values())
    best = sorted(got, key=lambda r: (-r["combined"], r["threshold"], r["radius"], r["least"]))
    assert [r["place"] for r in best] == list(range(1, 19))


def test_config_sweep_keeps_settings_without_pockets(spark, tmp_path):
    rows = [(k, "A", k, "A", 1, "GLY", float(k), 0.0, 0.0, 0.9, 1) for k in range(4)]
    got = {(r["threshold"], r["radius"], r["least"]): r for r in catalogue.queries()["config_sweep"](spark, written(spark, tmp_path, rows)).collect()}
    assert len(got) == 18 and got[0.95, 3.0, 3]["pockets"] == 0 and got[0.95, 3.0, 3]["combined"] == 0 and got[0.88, 3.0, 3]["combined"] == 1


def test_threshold_sweep_iou_against_brute_force(spark, tmp_path):
    rows = made_points(8)
    got = {r["threshold"]: r for r in catalogue.queries()["threshold_sweep_iou"](spark, written(spark, tmp_path, rows)).collect()}
    sites, means = sites_of(rows), {}
    for t in (0.88, 0.91, 0.95):
        pockets = pockets_of(rows, t, 3.0, 3)
        iou = lambda site, p: len(site & set(p[2])) / len(site | set(p[2]))
        per = {p: sum(max([iou(s, q) for q in pockets.get(p, [])], default=0) for s, _, _ in own) / len(own) for p, own in sites.items()}
        means[t] = sum(per.values()) / len({r[1] for r in rows})
        every = [q for own in pockets.values() for q in own]
        assert (got[t]["pockets"], got[t]["mean_gt_iou"]) == (len(every), pytest.approx(means[t], abs=2e-6))
        assert got[t]["mean_score"] == pytest.approx(sum(q[0] for q in every) / len(every), abs=2e-4)
        assert got[t]["mean_size"] == pytest.approx(sum(len(q[2]) for q in every) / len(every), abs=2e-6)
    assert len(set(means.values())) == 3 and len(sites) < len({r[1] for r in rows})
    assert [t for t in got if got[t]["best"]] == [max(means, key=means.get)]


def test_threshold_sweep_iou_agrees_with_pockets_ranked(spark, tmp_path):
    sf = written(spark, tmp_path, made_points(11))
    scores = [r["score"] for r in catalogue.queries()["pockets_ranked"](spark, sf).collect()]
    got = next(r for r in catalogue.queries()["threshold_sweep_iou"](spark, sf).collect() if r["threshold"] == 0.88)
    assert got["pockets"] == len(scores) and got["mean_score"] == pytest.approx(sum(scores) / len(scores), abs=2e-4)


def test_hull_volume_takes_grown_members(spark, tmp_path):
    """Three strong points have no volume; with the weak corner within 3.5 A of one of them they make a tetrahedron, and the far point stays out."""
    corners = [(0, 0, 0, 0.95), (2, 0, 0, 0.95), (0, 2, 0, 0.95), (0, 0, 3, 0.1), (0, 0, 9, 0.1)]
    rows = [(k, "A", k, "A", 1, "GLY", float(x), float(y), float(z), p, 0) for k, (x, y, z, p) in enumerate(corners)]
    got = catalogue.queries()["hull_volume"](spark, written(spark, tmp_path, rows)).collect()
    assert [(r["cluster_id"], r["volume"]) for r in got] == [(0, pytest.approx(2.0, abs=1e-4))]


def test_hull_volume_against_grown_sets(spark, tmp_path):
    rows = made_points(5)
    got = {r["cluster_id"]: r["volume"] for r in catalogue.queries()["hull_volume"](spark, written(spark, tmp_path, rows)).collect()}
    want = {p[1]: kernels.hull_volume(np.array([q[6:9] for q in p[2].values()])) for own in pockets_of(rows, 0.88, 3.0, 3).values() for p in own}
    assert got.keys() == want.keys() and len(got) > 3
    assert all(got[k] == (None if want[k] is None else pytest.approx(want[k], abs=1e-3)) for k in want)
