"""The run as a whole: structure text to atoms, features, pockets, their file and the summary; and the sweep of the residue pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelmill.functions import chemistry, expressions as X
from voxelmill.functions.expressions import distance2, rounded
from voxelmill.operators import graph, metrics as M, spatial
from voxelmill.plans.pockets import BASE, FULL, Pockets, _centres, _shared, _sites, aggregate, clusters, compared, pockets
from voxelmill.plans.registry import PTS, RES, points, query, residues
from voxelmill.plans.spatial import D2, _graph_neighbours
from voxelmill.sources import sinks, structures
from voxelmill.sources.tables import table
from voxelmill.storage import materialize

#: The atoms that stand for a residue of the table: name and place beside its own; the last is that of its side chain.
BACKBONE = (("N", -0.8, 0.4, 0.0), ("CA", 0.0, 0.0, 0.0), ("O", 0.9, -0.5, 0.3))
SIDE = (0.2, 1.2, -0.7)
SIDE_ATOMS = {"ARG": "NH1", "ASN": "ND2", "ASP": "OD1", "GLN": "NE2", "GLU": "OE1", "HIS": "ND1", "LYS": "NZ", "SER": "OG", "THR": "OG1", "TRP": "NE1", "TYR": "OH"}


def structure_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``protein_key, line``: fixed-width records of four atoms for every residue that has a place."""
    rows = table(spark, sf, "residues").where("xyz IS NOT NULL AND size(xyz) = 3 AND res_id IS NOT NULL")
    rows = rows.select("residue_uid", "protein_key", F.coalesce(F.upper(F.trim("res_name")), F.lit("UNK")).alias("res"), "res_id", F.coalesce("rsa", F.lit(0.0)).alias("rsa"), *[F.col("xyz")[k].alias(a) for k, a in enumerate("xyz")])
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)").distinct()
    side = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in SIDE_ATOMS.items() for v in p]), F.col("res")), F.lit("CB"))
    atoms = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for n, a, b, c in BACKBONE], F.struct(side.alias("n"), *[F.lit(v).alias(k) for k, v in zip("abc", SIDE)]))
    each = rows.select("*", F.posexplode(atoms).alias("k", "o"))
    place = tuple(F.col(v) + F.col(f"o.{d}") for v, d in zip("xyz", "abc"))
    chain = F.substring_index("protein_key", "_", -1)
    line = structures.record_line("ATOM", F.col("residue_uid") * 4 + F.col("k"), F.col("o.n"), F.substring("res", 1, 3), chain, F.col("res_id"), place, F.lit(1.0), F.col("rsa") * 10, F.substring("o.n", 1, 1))
    return each.select("protein_key", line.alias("line"))


def _cell(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


ATOMS = f"""rsd AS (SELECT DISTINCT residue_uid, protein_key, substr(coalesce(upper(trim(res_name)), 'UNK'), 1, 3) AS res, res_id, coalesce(rsa, 0.0) AS rsa, xyz[1] AS x, xyz[2] AS y, xyz[3] AS z FROM residues
  WHERE xyz IS NOT NULL AND len(xyz) = 3 AND res_id IS NOT NULL AND xyz[1] IS NOT NULL AND xyz[2] IS NOT NULL AND xyz[3] IS NOT NULL AND NOT isnan(xyz[1]) AND NOT isnan(xyz[2]) AND NOT isnan(xyz[3])),
side(res, n) AS (VALUES {", ".join(f"('{r}', '{a}')" for r, a in SIDE_ATOMS.items())}),
offs(k, n, a, b, c) AS (VALUES {", ".join(f"({k}, '{n}', {a}, {b}, {c})" for k, (n, a, b, c) in enumerate(BACKBONE))}, (3, NULL, {SIDE[0]}, {SIDE[1]}, {SIDE[2]})),
atoms AS (SELECT protein_key, residue_uid * 4 + k AS atom, res_id, rsd.res, coalesce(offs.n, side.n, 'CB') AS n, {_cell("x + a", 3)} AS x, {_cell("y + b", 3)} AS y, {_cell("z + c", 3)} AS z, {_cell("rsa * 10", 2)} AS bfactor FROM rsd CROSS JOIN offs LEFT JOIN side ON rsd.res = side.res)"""


def parsed_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms read from the text, which is written first: every column is cut out of a stored line."""
    return structures.parse_atoms(materialize(structure_lines(spark, sf), "lines"))


def _kind_values() -> tuple[str, str]:
    """SQL rows of every kind of atom, by residue and name, and of names alone for other residues: the values that an atom adds."""
    def value(res: str, atom: str) -> list[float]:
        has = lambda c: float(res in chemistry.CLASSES[c].split())
        own = [has("hydrophobic"), has("hydrophilic"), chemistry.HYDROPATHY.get(res, 0.0), *(has(c) for c in ("aliphatic", "aromatic", "sulfur", "hydroxyl")), chemistry.BASIC.get(res, 0.0)]
        own += [has(c) for c in ("acidic", "amide", "pos_charge", "neg_charge", "h_donor", "h_acceptor", "h_donor_acceptor", "polar", "ionizable")]
        gives = {"ARG": "NE NH1 NH2", "ASN": "ND2", "GLN": "NE2", "HIS": "ND1 NE2", "LYS": "NZ", "SER": "OG", "THR": "OG1", "TRP": "NE1", "TYR": "OH"}
        takes = {"ASN": "OD1", "ASP": "OD1 OD2", "GLN": "OE1", "GLU": "OE1 OE2", "HIS": "ND1 NE2", "SER": "OG", "THR": "OG1", "TYR": "OH"}
        own += [1.0, 1.0, *(float(atom[0] == e) for e in "CON"), float(atom in gives.get(res, "").split()), float(atom in takes.get(res, "").split())]
        flag = lambda name: float(any(name in f.split() for f, atoms, rs in chemistry.FLAGS if (f, atoms, rs) == first))
        first = next((r for r in chemistry.FLAGS if atom in r[1].split() and (r[2] is None or res in r[2].split())), None)
        return own + [flag(n) for n in chemistry.FLAG_NAMES]

    names = [n for n, *_ in BACKBONE]
    rows = [(r, a) for r in chemistry.HYDROPATHY for a in [*names, SIDE_ATOMS.get(r, "CB")]] + [("*", a) for a in [*names, "CB"]]
    columns = [*chemistry.CHEM_COLUMNS, *chemistry.FLAG_COLUMNS]
    return ", ".join(columns), ", ".join(f"('{r}', '{a}', {', '.join(map(str, value(r, a)))})" for r, a in rows)


_COLUMNS, _ROWS = _kind_values()
TOLD = [*chemistry.CHEM_COLUMNS, *chemistry.FLAG_COLUMNS, "bfactor"]
#: Values of the atom table that stand in for the file's.
AP = [("ALA.CA", 0.6, -0.5, -1.0), ("GLY.CA", 0.7, 0.4, 1.0), ("SER.OG", 1.2, -0.3, -1.0), ("LYS.NZ", 0.3, 0.9, -1.0), ("LEU.CB", 0.5, 0.6, 1.0)]


@query(f"""WITH {PTS}, {ATOMS}, kinds(r, a, {_COLUMNS}) AS (VALUES {_ROWS}), ap(k, v1, v2, v3) AS (VALUES {", ".join(map(str, AP))}),
vec AS (SELECT atoms.protein_key, atoms.x, atoms.y, atoms.z, bfactor, kinds.*, coalesce(abs(v1)**2, 0) AS v1, coalesce(abs(v2)**2, 0) AS v2, coalesce(abs(v3)**2, 0) AS v3
  FROM atoms JOIN kinds ON kinds.a = atoms.n AND kinds.r = CASE WHEN res IN ({", ".join(f"'{r}'" for r in chemistry.HYDROPATHY)}) THEN res ELSE '*' END LEFT JOIN ap ON ap.k = res || '.' || n),
near AS (SELECT a.point_id, {D2} AS d2, b.* FROM pts a JOIN vec b ON a.protein_key = b.protein_key AND {D2} <= 11.3*11.3),
sums AS (SELECT point_id, {", ".join(("count(*) FILTER (WHERE d2 <= 36)" if c == "atoms" else f"sum(CASE WHEN d2 <= 36 THEN greatest(0.0, 1 - sqrt(d2)/6) ELSE 0 END * {c})") + f" AS {c}" for c in TOLD)},
  sum(CASE WHEN d2 <= 36 THEN greatest(0.0, 1 - sqrt(d2)/6) ELSE 0 END * v1) AS "apRawValids", sum(CASE WHEN d2 <= 36 THEN greatest(0.0, 1 - sqrt(d2)/6) ELSE 0 END * v2) AS "apRawInvalids", sum(CASE WHEN d2 <= 36 THEN greatest(0.0, 1 - sqrt(d2)/6) ELSE 0 END * v3) AS "atomicHydrophobicity", count(*) AS protrusion FROM near GROUP BY point_id)
SELECT pts.point_id, {", ".join(f"round(CAST(coalesce({c}, 0) AS DOUBLE), 4) AS {c}" for c in [*TOLD, '"apRawValids"', '"apRawInvalids"', '"atomicHydrophobicity"', "protrusion"])} FROM pts LEFT JOIN sums ON pts.point_id = sums.point_id""")
def point_features(spark: SparkSession, sf: str) -> DataFrame:
    """The 35 features of every point from the atoms of the parsed structure text."""
    atoms = materialize(parsed_atoms(spark, sf).select("protein_key", "atom_name", "residue_name", "element", "bfactor", *spatial.AXES), "atoms")
    dim = spark.createDataFrame(AP, "atomName string, apRawValids double, apRawInvalids double, atomicHydrophobicity double")
    rows = chemistry.point_features(points(spark, sf).select("protein_key", "point_id", *spatial.AXES), atoms, "protein_key", "point_id", chemistry.atom_vectors(atoms, dim))
    return rows.select("point_id", *[rounded(F.col(c), 4).alias(c) for c in rows.columns if c != "point_id"])


@query(f"""WITH {ATOMS} SELECT res AS residue_name, n AS atom_name, count(*) AS atoms, count(*) FILTER (WHERE n LIKE 'C%') AS "atomC", count(*) FILTER (WHERE n LIKE 'O%') AS "atomO", count(*) FILTER (WHERE n LIKE 'N%') AS "atomN",
  count(*) FILTER (WHERE (res = 'ARG' AND n IN ('NE', 'NH1', 'NH2')) OR (res = 'ASN' AND n = 'ND2') OR (res = 'GLN' AND n = 'NE2') OR (res = 'HIS' AND n IN ('ND1', 'NE2')) OR (res = 'LYS' AND n = 'NZ') OR (res = 'SER' AND n = 'OG') OR (res = 'THR' AND n = 'OG1') OR (res = 'TRP' AND n = 'NE1') OR (res = 'TYR' AND n = 'OH')) AS "hDonorAtoms",
  count(*) FILTER (WHERE (res = 'ASN' AND n = 'OD1') OR (res IN ('ASP') AND n IN ('OD1', 'OD2')) OR (res = 'GLN' AND n = 'OE1') OR (res = 'GLU' AND n IN ('OE1', 'OE2')) OR (res = 'HIS' AND n IN ('ND1', 'NE2')) OR (res = 'SER' AND n = 'OG') OR (res = 'THR' AND n = 'OG1') OR (res = 'TYR' AND n = 'OH')) AS "hAcceptorAtoms" FROM atoms GROUP BY res, n""")
def atom_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms of every kind, with those that give or take a hydrogen bond."""
    atoms = parsed_atoms(spark, sf)
    own = chemistry.atom_features(F.col("atom_name"), F.col("element"), F.col("residue_name"))
    sums = [F.sum(v).cast("long").alias(c) for c, v in own.items() if c != "atomDensity"]
    return atoms.groupBy("residue_name", "atom_name").agg(*sums)


MEAN, STDEV = 12.0, 9.0
TP, FP = [0.0, 4.0, 10.0, 18.0, 28.0, 40.0], [5.0, 40.0, 70.0, 90.0, 100.0, 104.0]
NEAREST = f"""na AS (SELECT point_id, res_id FROM (SELECT a.point_id, b.res_id, row_number() OVER (PARTITION BY a.point_id ORDER BY {D2}, b.atom) AS r FROM pts a JOIN atoms b ON a.protein_key = b.protein_key) WHERE r = 1),
surf AS (SELECT grown.protein_key, grown.cluster_id, count(DISTINCT coalesce(na.res_id, -1)) AS surface FROM grown LEFT JOIN na ON grown.point_id = na.point_id GROUP BY ALL),
hist AS (SELECT protein_key, cluster_id, score/5.0 AS pos, least(greatest(CAST(floor(score/5.0) AS INT), 0), 5) AS k FROM ranked),
hv AS (SELECT *, least(greatest(pos-k, 0.0), 1.0) AS s, {TP}[k+1] AS t0, {TP}[least(k+2, 6)] AS t1, {FP}[k+1] AS f0, {FP}[least(k+2, 6)] AS f1 FROM hist),
hp AS (SELECT protein_key, cluster_id, CASE WHEN k < 5 THEN t0+(t1-t0)*s ELSE t0 END AS t, CASE WHEN k < 5 THEN f0+(f1-f0)*s ELSE f0 END AS f FROM hv)"""


def pocket_rows(made: Pockets, surface: DataFrame) -> DataFrame:
    """Ranked pockets as rows of the pocket file's table. surface: ``protein_key, cluster_id, surface``."""
    volumes = graph.hull_volumes(made.grown.join(made.points.select("point_id", *spatial.AXES), "point_id"), "protein_key", "cluster_id")
    count = made.ranked.groupBy("protein_key").agg(F.count("*").cast("int").alias("n_pockets"))
    rows = made.ranked.join(count, "protein_key").join(surface, ["protein_key", "cluster_id"]).join(volumes, ["protein_key", "cluster_id"], "left")
    score = F.col("score")
    return rows.select(
        F.col("protein_key").alias("file_name"), F.lit(0).alias("n_ligands"), "n_pockets", F.concat(F.lit("pocket"), F.col("rank").cast("string")).alias("pocket"), F.lit("").alias("ligand"), "rank", "score", F.col("rank").alias("new_rank"), score.alias("old_score"),
        X.z_score(score, MEAN, STDEV).alias("z_score_tp"), X.histogram_probability(score, 0.0, 30.0, TP, FP).alias("proba_tp"), "sample_points", F.col("sum_prob").alias("raw_new_score"), F.col("volume").alias("pocket_volume"), F.col("surface").alias("surface_atoms"),
    )


@query(f"""{BASE}, {ATOMS}, {NEAREST}
SELECT r.protein_key AS file, '0' AS "#ligands", CAST(count(*) OVER (PARTITION BY r.protein_key) AS VARCHAR) AS "#pockets", 'pocket' || CAST(rank AS VARCHAR) AS pocket, '' AS ligand, CAST(rank AS VARCHAR) AS rank, printf('%.6f', score) AS score, CAST(rank AS VARCHAR) AS "newRank", printf('%.6f', score) AS "oldScore",
  printf('%.4f', CAST(printf('%.6f', (score - {MEAN}) / {STDEV}) AS DOUBLE) + 1e-9) AS "zScoreTP", printf('%.4f', CAST(printf('%.6f', CASE WHEN t+f > 0 THEN t/(t+f) ELSE 0 END) AS DOUBLE) + 1e-9) AS "probaTP", CAST(sample_points AS VARCHAR) AS "samplePoints", printf('%.6f', sum_prob) AS "rawNewScore", CAST(surface AS VARCHAR) AS "surfaceAtoms"
FROM ranked r JOIN surf ON surf.protein_key = r.protein_key AND surf.cluster_id = r.cluster_id JOIN hp ON hp.protein_key = r.protein_key AND hp.cluster_id = r.cluster_id""")
def end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Structure text to atoms, points to their nearest residues, scores to pockets, and these to the cells of the pocket file; the hull's volume alone has no SQL and is left to ``end_to_end_file``."""
    file = end_to_end_file(spark, sf)
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double") + 1e-9)
    return file.drop("pocketVolume").withColumn("zScoreTP", four("zScoreTP")).withColumn("probaTP", four("probaTP"))


def end_to_end_file(spark: SparkSession, sf: str) -> DataFrame:
    """The 15 cells of every pocket."""
    atoms = materialize(parsed_atoms(spark, sf).select("protein_key", "atom_id", "residue_number", *spatial.AXES), "atoms")
    made = pockets(spark, sf, keep=True)
    members = materialize(made.grown.join(made.points.select("point_id", *spatial.AXES), "point_id"), "members")
    near = spatial.nearest_join(members.select("protein_key", "point_id", *spatial.AXES).distinct(), atoms.withColumn("atom", F.struct("atom_id", "residue_number")).select("protein_key", "atom", *spatial.AXES), "protein_key", "point_id", "atom", 4.0)
    residue = near.select("protein_key", "point_id", F.col("atom.residue_number").alias("res"))
    surface = members.join(residue, ["protein_key", "point_id"], "left").groupBy("protein_key", "cluster_id").agg(F.countDistinct(F.coalesce("res", F.lit(-1))).alias("surface"))
    return sinks.pocket_file(pocket_rows(made, surface))


METRICS = (
    "total_proteins", "proteins_attempted", "total_pockets_eval", "total_pockets_all", "avg_pockets_per_protein_eval", "avg_pockets_per_protein_all", "avg_pocket_score_eval", "avg_pocket_score_all",
    "max_pocket_score_eval", "max_pocket_score_all", "avg_mean_gt_iou_default", "avg_best_iou", "avg_gt_coverage",
)
TOP = 3


@query(f"""{FULL}, prot AS (SELECT DISTINCT protein_key FROM pts), every AS (SELECT DISTINCT protein_key FROM sas_points),
b AS (SELECT gs.protein_key, gs.site_id, coalesce(max(iou), 0) AS b FROM gs LEFT JOIN (SELECT protein_key, site_id, iou FROM cmp WHERE rank <= {TOP}) c ON c.protein_key = gs.protein_key AND c.site_id = gs.site_id GROUP BY ALL),
g AS (SELECT protein_key, avg(b) AS m, max(b) AS t, avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END) AS c FROM b GROUP BY protein_key),
n AS (SELECT count(*) AS n FROM prot), e AS (SELECT count(*) AS n, avg(score) AS m, max(score) AS t FROM ranked WHERE rank <= {TOP}), a AS (SELECT count(*) AS n, avg(score) AS m, max(score) AS t FROM ranked),
one AS (SELECT n.n AS total_proteins, (SELECT count(*) FROM every) AS proteins_attempted, e.n AS total_pockets_eval, a.n AS total_pockets_all, e.n/n.n AS avg_pockets_per_protein_eval, a.n/n.n AS avg_pockets_per_protein_all, coalesce(e.m, 0) AS avg_pocket_score_eval, coalesce(a.m, 0) AS avg_pocket_score_all,
  coalesce(e.t, 0) AS max_pocket_score_eval, coalesce(a.t, 0) AS max_pocket_score_all, coalesce((SELECT sum(m) FROM g), 0)/n.n AS avg_mean_gt_iou_default, coalesce((SELECT sum(t) FROM g), 0)/n.n AS avg_best_iou, coalesce((SELECT sum(c) FROM g), 0)/n.n AS avg_gt_coverage FROM n, e, a)
""" + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(CAST({c} AS DOUBLE), 5) AS value FROM one" for c in METRICS))
def production_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The 13 figures of a run, the first three pockets of a protein being evaluated; proteins without sites count 0."""
    truth = compared(spark, sf)
    ranked, n = truth.made.ranked, F.col("n")
    best = truth.pairs.where(F.col("rank") <= TOP).groupBy("protein_key", "site_id").agg(F.max("iou").alias("b"))
    sites = truth.sites.select("protein_key", "site_id").join(best, ["protein_key", "site_id"], "left").fillna(0.0, ["b"])
    per = sites.groupBy("protein_key").agg(F.avg("b").alias("m"), F.max("b").alias("t"), F.avg((F.col("b") > 0).cast("double")).alias("c")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in "mtc"])
    top = F.col("rank") <= TOP
    sums = ranked.agg(F.count(F.when(top, 1)).alias("en"), F.avg(F.when(top, F.col("score"))).alias("em"), F.max(F.when(top, F.col("score"))).alias("et"), F.count("*").alias("an"), F.avg("score").alias("am"), F.max("score").alias("at"))
    count = truth.made.points.agg(F.countDistinct("protein_key").alias("n"))
    attempted = table(spark, sf, "sas_points").where("protein_key IS NOT NULL").agg(F.countDistinct("protein_key").alias("every"))
    one = reduce(lambda a, b: a.join(b, "k"), [d.withColumn("k", F.lit(1)) for d in (sums, per, count, attempted)])  # a row each
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = (n, F.col("every"), F.col("en"), F.col("an"), F.col("en") / n, F.col("an") / n, zero("em"), zero("am"), zero("et"), zero("at"), F.col("m") / n, F.col("t") / n, F.col("c") / n)
    return sinks.metric_rows(one.select(*[rounded(v.cast("double"), 5).alias(c) for c, v in zip(METRICS, values)]), METRICS)


ROLL = ("n_points", "n_pockets", "max_score", "sum_score")


@query(f"""{FULL}, p AS (SELECT protein_key, count(*) AS n_points FROM pts GROUP BY protein_key), r AS (SELECT protein_key, count(*) AS n_pockets, max(score) AS max_score, sum(score) AS sum_score FROM ranked GROUP BY protein_key),
b AS (SELECT gs.protein_key, gs.site_id, coalesce(max(iou), 0) AS b FROM gs LEFT JOIN cmp ON cmp.protein_key = gs.protein_key AND cmp.site_id = gs.site_id GROUP BY ALL), g AS (SELECT protein_key, avg(b) AS mean_iou FROM b GROUP BY protein_key),
per AS (SELECT n_points, coalesce(n_pockets, 0) AS n_pockets, coalesce(max_score, 0) AS max_score, coalesce(sum_score, 0) AS sum_score, mean_iou FROM p LEFT JOIN r USING (protein_key) LEFT JOIN g USING (protein_key))
""" + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(CAST(sum({c}) AS DOUBLE), 3) AS total, count({c}) AS proteins FROM per" for c in (*ROLL, "mean_iou")))
def dataset_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, population deviation and total of each protein's figures; IoU only over proteins that have sites."""
    truth = compared(spark, sf)
    p = truth.made.points.groupBy("protein_key").agg(F.count("*").alias("n_points"))
    r = truth.made.ranked.groupBy("protein_key").agg(F.count("*").alias("n_pockets"), F.max("score").alias("max_score"), F.sum("score").alias("sum_score"))
    best = truth.pairs.groupBy("protein_key", "site_id").agg(F.max("iou").alias("b"))
    g = truth.sites.select("protein_key", "site_id").join(best, ["protein_key", "site_id"], "left").fillna(0.0, ["b"]).groupBy("protein_key").agg(F.avg("b").alias("mean_iou"))
    per = p.join(r, "protein_key", "left").fillna(0, list(ROLL)).join(g, "protein_key", "left")
    names = (*ROLL, "mean_iou")
    long = per.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', cast({c} AS double)" for c in names) + ") AS (metric, v)"))
    return long.groupBy("metric").agg(rounded(F.avg("v"), 4).alias("mean"), rounded(F.stddev_pop("v"), 4).alias("std"), rounded(F.sum("v"), 3).alias("total"), F.count("v").alias("proteins"))


RADII, SIZES, SUMS, MODES = (6.0, 7.0, 8.0), (3, 5, 8), (1.5, 2.0, 3.0), {"percentile95": 0.95, "prevalence": 0.97}
CONFIG = ["radius", "least", "least_sum", "mode"]


@query()
def residue_config_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """54 settings of the residue pipeline (graph radius, size, probability sum, threshold mode), each run to its five best pockets and held against the labelled sites; best first.

    A setting's weight is .3 R@1 + .3 R@3 + .2 mean IoU + .2 precision; objective
    is .4, .3, .2 and .1 of R@1, R@3, mean IoU and F1. Thresholds, neighbours
    and components are found once for all settings that share them. Sites are
    taken as the residues of their points. No SQL, as matching is sequential.
    """
    rows = materialize(residues(spark, sf).where("prob IS NOT NULL AND res_id IS NOT NULL"), "residues")
    cuts = M.quantiles(rows, ["protein_key"], "prob", MODES)
    mode = F.explode(F.create_map(*[x for m in MODES for x in (F.lit(m), F.col(m))])).alias("mode", "cut")
    pos = rows.where("rsa >= 0.2").join(cuts.select("protein_key", mode), "protein_key").where("prob >= cut")
    edges = materialize(_graph_neighbours(spark, sf).where("residue_uid <> other").select("protein_key", F.least("residue_uid", "other").alias("a"), F.greatest("residue_uid", "other").alias("b"), "d2").distinct(), "edges")
    setting = lambda r: F.concat_ws("|", "protein_key", F.col("mode"), F.lit(str(r)))
    named = []
    pos = materialize(pos, "positive")
    for r in RADII:
        ends = pos.select("mode", "residue_uid")
        inner = edges.where(F.col("d2") <= r * r).join(ends.withColumnRenamed("residue_uid", "a"), "a").join(ends.withColumnRenamed("residue_uid", "b"), ["b", "mode"])
        label = graph.group_components(inner.select(setting(r).alias("g"), "a", "b"), "g", keep_group=True)
        own = pos.withColumn("g", setting(r)).join(label.withColumnRenamed("id", "residue_uid"), ["g", "residue_uid"], "left")
        named.append(own.withColumn("radius", F.lit(r)).withColumn("cluster_id", F.coalesce("component", "residue_uid")))
    members = materialize(reduce(DataFrame.unionByName, named).select("protein_key", "mode", "radius", "cluster_id", "residue_uid", "res_id", "prob", *spatial.AXES), "members")
    keys = ["protein_key", "mode", "radius", "cluster_id"]
    sums = members.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("prob").alias("total"), F.countDistinct("res_id").alias("sample_points"), *[(F.sum(F.col("prob") * F.col(a)) / (F.sum("prob") + 1e-8)).alias(f"c{a}") for a in spatial.AXES])
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("least"), F.lit(t).alias("least_sum")) for m in SIZES for t in SUMS])).alias("s")
    fit = sums.select("*", grid).select("*", "s.*").drop("s").where("n >= least AND total >= least_sum")
    ranked = materialize(graph.place(fit, ["protein_key", *CONFIG], F.desc("total"), "cluster_id").where("rank <= 5"), "ranked")
    pts = materialize(points(spark, sf), "points")
    site = materialize(_sites(pts).join(pts.select("point_id", "residue_number"), "point_id"), "site")
    sites = materialize(_centres(site).join(site.groupBy("site_id").agg(F.countDistinct("residue_number").alias("size")), "site_id"), "sites")
    of_site = site.select("protein_key", "site_id", F.col("residue_number").alias("res_id")).distinct()
    shared = members.select(*keys, "res_id").distinct().join(of_site, ["protein_key", "res_id"]).groupBy(*keys, "site_id").agg(F.count("*").alias("overlap"))
    centre = ranked.select(*keys, *[F.col(f"c{a}").alias(a) for a in spatial.AXES]).distinct()
    close = spatial.radius_join(centre, sites.select("protein_key", "site_id", *[F.col(f"g{a}").alias(a) for a in spatial.AXES]), "protein_key", 6.0).select(*keys, "site_id", F.lit(0).cast("long").alias("overlap"))
    valid = shared.unionByName(close).groupBy(*keys, "site_id").agg(F.max("overlap").alias("overlap"))
    pairs = valid.join(ranked.select(*keys, "least", "least_sum", "rank", "sample_points"), keys).join(sites.select("protein_key", "site_id", "size"), ["protein_key", "site_id"])
    pairs = pairs.withColumn("iou", F.col("overlap") / (F.col("sample_points") + F.col("size") - F.col("overlap"))).withColumn("pocket", F.struct(*CONFIG, "cluster_id")).withColumn("place", F.struct(*CONFIG, "site_id"))
    match = graph.greedy_match(pairs.select("protein_key", *CONFIG, "pocket", "place", "rank", "iou"), "pocket", "place", [-F.col("iou"), F.col("rank")])
    found = match.groupBy(*CONFIG, "protein_key").agg(F.min("rank").alias("first"), F.count("*").alias("m"), F.sum("iou").alias("iou"))
    hits = found.groupBy(*CONFIG).agg(F.sum("m").alias("matches"), F.sum("iou").alias("iou"), *[F.count_if(F.col("first") <= k).alias(f"hit{k}") for k in (1, 3)])
    made = ranked.groupBy(*CONFIG).agg(F.count("*").alias("pockets"))
    settings = spark.createDataFrame([(r, m, t, s) for r in RADII for m in SIZES for t in SUMS for s in MODES], "radius double, least int, least_sum double, mode string")
    rows = settings.join(made, CONFIG, "left").join(hits, CONFIG, "left").fillna(0)
    labelled, total = sites.select(F.countDistinct("protein_key")).scalar(), sites.select(F.count("*")).scalar()
    share = lambda a, b: F.when(b > 0, F.col(a) / b).otherwise(0.0)
    p, c = F.col("matches") / (F.col("pockets") + 1e-8), F.col("matches") / (total + 1e-8)
    rows = rows.select(*CONFIG, "pockets", "matches", share("hit1", labelled).alias("recall_at_1"), share("hit3", labelled).alias("recall_at_3"), share("iou", F.col("matches")).alias("mean_iou"), p.alias("precision"), c.alias("recall"), (2 * p * c / (p + c + 1e-8)).alias("f1"))
    weigh = lambda w, last: rounded(sum((F.col(n) * v for n, v in zip(("recall_at_1", "recall_at_3", "mean_iou", last), w)), F.lit(0.0)), 6)
    rows = rows.withColumn("combined", weigh((0.3, 0.3, 0.2, 0.2), "precision")).withColumn("objective", weigh((0.4, 0.3, 0.2, 0.1), "f1"))
    order = Window.orderBy(F.desc("combined"), *CONFIG)  # one row a setting
    return rows.select(*CONFIG, "pockets", "matches", *[rounded(F.col(n), 6).alias(n) for n in ("recall_at_1", "recall_at_3", "mean_iou", "precision", "recall", "f1")], "combined", "objective", F.row_number().over(order).alias("place"))
