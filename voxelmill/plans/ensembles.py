"""Several seeds or settings taken together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelmill.functions.expressions import rounded
from voxelmill.operators import graph
from voxelmill.plans.pockets import RESIDUE_SQL, clusters
from voxelmill.plans.registry import CLUSTERS, PKT, PTS, points, query, ranked, residues
from voxelmill.plans.spatial import D2, _graph_neighbours
from voxelmill.storage import materialize

# fixed values: weights of the seeds, by their published precision
SEEDS = {1: 0.4048, 2: 0.3986, 3: 0.3970, 4: 0.3813, 5: 0.3676, 6: 0.3641, 7: 0.3632}
WEIGHTS = "w(seed_no, w) AS (VALUES " + ", ".join(f"({k}, {v})" for k, v in SEEDS.items()) + ")"
ONE = "one AS (SELECT protein_key, rank, seed_no, max(score) AS score FROM pkt WHERE rank IS NOT NULL GROUP BY ALL)"


def _by_seed(spark: SparkSession, sf: str) -> DataFrame:
    """One score for each protein, rank and seed."""
    return ranked(spark, sf).where("rank IS NOT NULL").groupBy("protein_key", "rank", "seed_no").agg(F.max("score").alias("score"))


@query(f"WITH {PKT}, {ONE} SELECT protein_key, rank, round(avg(score), 6) AS score, count(*) AS seeds FROM one GROUP BY protein_key, rank")
def seed_ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score over seeds."""
    return _by_seed(spark, sf).groupBy("protein_key", "rank").agg(rounded(F.avg("score"), 6).alias("score"), F.count("*").alias("seeds"))


@query(f"WITH {PKT}, {ONE} SELECT protein_key, rank, round(quantile_cont(score, 0.5), 6) AS score FROM one GROUP BY protein_key, rank")
def seed_ensemble_median(spark: SparkSession, sf: str) -> DataFrame:
    """Median score over seeds."""
    return _by_seed(spark, sf).groupBy("protein_key", "rank").agg(rounded(F.expr("percentile(score, 0.5)"), 6).alias("score"))


@query(f"WITH {PKT}, {ONE}, {WEIGHTS} SELECT protein_key, rank, round(sum(score*w)/sum(w), 6) AS score FROM one JOIN w ON one.seed_no = w.seed_no GROUP BY protein_key, rank")
def seed_ensemble_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score over seeds by their weights."""
    w = F.broadcast(spark.createDataFrame(list(SEEDS.items()), "seed_no int, w double"))
    return _by_seed(spark, sf).join(w, "seed_no").groupBy("protein_key", "rank").agg(rounded(F.sum(F.col("score") * F.col("w")) / F.sum("w"), 6).alias("score"))


@query(f"WITH {PKT}, {ONE} SELECT a.seed_no AS seed_a, b.seed_no AS seed_b, count(*) AS n, round(corr(a.score, b.score), 5) AS correlation FROM one a JOIN one b ON a.protein_key = b.protein_key AND a.rank = b.rank AND a.seed_no < b.seed_no GROUP BY ALL")
def seed_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of scores for each pair of seeds; the join is on protein and rank, at most one row a seed."""
    a = _by_seed(spark, sf)
    b = a.select("protein_key", "rank", F.col("seed_no").alias("seed_b"), F.col("score").alias("other"))
    pairs = a.withColumnRenamed("seed_no", "seed_a").join(b, ["protein_key", "rank"]).where("seed_a < seed_b")
    return pairs.groupBy("seed_a", "seed_b").agg(F.count("*").alias("n"), rounded(F.corr("score", "other"), 5).alias("correlation"))


LEVELS = (0.88, 0.91, 0.95)


def _level_sql(k: int, least: float) -> str:
    text = CLUSTERS.format(least=least, radius=3.0, size=3)
    for name in ("strong", "links", "walk", "named", "core"):
        text = text.replace(f"{name} AS (", f"{name}{k} AS (").replace(f"FROM {name} ", f"FROM {name}{k} ").replace(f"JOIN {name} ", f"JOIN {name}{k} ").replace(f"FROM {name})", f"FROM {name}{k})")
    text = text.replace("walk.", f"walk{k}.").replace("links.", f"links{k}.").replace(f"FROM walk{k} GROUP", f"FROM walk{k} GROUP").replace(f"JOIN links ON", f"JOIN links{k} ON").replace(f"UNION SELECT walk{k}.id, links{k}.b FROM walk JOIN", f"UNION SELECT walk{k}.id, links{k}.b FROM walk{k} JOIN")
    return text


CONSENSUS = f"WITH RECURSIVE {PTS}, " + ", ".join(_level_sql(k, v) for k, v in enumerate(LEVELS)) + ", c AS (" + " UNION ALL ".join(
    f"SELECT {k} AS seed, protein_key, {k}*1000000000000 + cluster_id AS id, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z, round(sum(prob*prob), 6) AS score, count(*) AS size FROM core{k} GROUP BY protein_key, cluster_id" for k in range(3)
) + f"""), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.protein_key = b.protein_key AND {D2} <= 36.0),
cw AS (SELECT id, id AS reach FROM c UNION SELECT cw.id, e.b FROM cw JOIN e ON cw.reach = e.a), cn AS (SELECT id, min(reach) AS pocket FROM cw GROUP BY id)
SELECT protein_key, pocket, round(avg(score), 5) AS score, CAST(floor(avg(size)) AS BIGINT) AS size, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, round(count(DISTINCT seed)/3.0, 6) AS agreement FROM cn JOIN c USING (id) GROUP BY protein_key, pocket"""


@query(CONSENSUS)
def consensus_pockets(spark: SparkSession, sf: str) -> DataFrame:
    """Pockets of three runs whose centres lie within 6 A, through others too, as one, with the share of runs that agree."""
    pts = materialize(points(spark, sf), "points")
    runs = []
    for k, least in enumerate(LEVELS):
        core = clusters(pts, least)
        centre = core.groupBy("protein_key", "cluster_id").agg(*[rounded(F.avg(a), 5).alias(a) for a in "xyz"], rounded(F.sum(F.col("prob") * F.col("prob")), 6).alias("score"), F.count("*").alias("size"))
        runs.append(centre.withColumn("seed", F.lit(k)).withColumn("id", F.lit(k * 10**12) + F.col("cluster_id")))
    every = materialize(reduce(DataFrame.unionByName, runs), "runs")
    label = graph.density_clusters(every, "protein_key", "id", 6.0).select("id", F.col("cluster_id").alias("pocket"))
    return every.join(label, "id").groupBy("protein_key", "pocket").agg(rounded(F.avg("score"), 5).alias("score"), F.floor(F.avg("size")).alias("size"), *[rounded(F.avg(a), 4).alias(a) for a in "xyz"], rounded(F.countDistinct("seed") / 3.0, 6).alias("agreement"))


SMOOTH = RESIDUE_SQL[: RESIDUE_SQL.index(",\npos AS")] + """, nb AS (SELECT both_e.a, avg(res.prob) AS m FROM both_e JOIN res ON both_e.b = res.residue_uid WHERE res.prob IS NOT NULL GROUP BY both_e.a)
SELECT residue_uid, round(CASE WHEN m IS NULL THEN prob ELSE 0.7*prob + 0.3*m END, 6) AS kept, round(CASE WHEN m IS NULL THEN 0.7*prob ELSE 0.7*prob + 0.3*m END, 6) AS shrunk FROM res LEFT JOIN nb ON residue_uid = a WHERE prob IS NOT NULL"""


@query(SMOOTH)
def graph_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities smoothed over the residue graph, lone residues kept or shrunk."""
    rows = materialize(residues(spark, sf).where("prob IS NOT NULL").select("residue_uid", "prob"), "residues")
    edges = materialize(graph.knn_graph(_graph_neighbours(spark, sf), "protein_key", "residue_uid", "other", 8.0).select("a", "b"), "edges")
    kept = graph.smooth(rows, "residue_uid", "prob", edges, 0.7, 1, "keep").select("residue_uid", rounded(F.col("prob"), 6).alias("kept"))
    shrunk = graph.smooth(rows, "residue_uid", "prob", edges, 0.7, 1, "shrink").select("residue_uid", rounded(F.col("prob"), 6).alias("shrunk"))
    return kept.join(shrunk, "residue_uid")
