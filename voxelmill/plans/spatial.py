"""Joins by distance and what is aggregated over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelmill.functions.expressions import falloff, neighbour_weights, rounded
from voxelmill.operators import spatial
from voxelmill.operators.graph import knn_graph
from voxelmill.plans.registry import PTS, RES, points, query, residues
from voxelmill.storage import materialize

D2 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


@query(f"WITH {PTS} SELECT a.protein_key, a.point_id AS a, b.point_id AS b, round({D2}, 6) AS d2 FROM pts a JOIN pts b ON a.protein_key = b.protein_key AND a.point_id < b.point_id AND {D2} <= 9.0")
def radius_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of points of a protein within 3 A."""
    return spatial.radius_pairs(points(spark, sf), "protein_key", "point_id", 3.0).withColumn("d2", rounded(F.col("d2"), 6))


@query(f"""WITH {PTS}, {RES},
near AS (SELECT a.point_id, b.rsa, b.prob, {D2} AS d2 FROM pts a JOIN res b ON a.protein_key = b.protein_key AND {D2} <= 11.3*11.3)
SELECT point_id, round(sum(CASE WHEN d2 <= 36 THEN greatest(0.0, 1 - sqrt(d2)/6) END), 5) AS weight, round(sum(CASE WHEN d2 <= 36 THEN greatest(0.0, 1 - sqrt(d2)/6) * rsa END), 5) AS rsa_sum,
  count(*) FILTER (WHERE d2 <= 36) AS atoms, count(*) AS protrusion FROM near GROUP BY point_id""")
def neighbour_weighted_features(spark: SparkSession, sf: str) -> DataFrame:
    """Of residues within 6 A of each point, sums weighted by 1 - d/6; of those within 11.3 A, the number."""
    near = spatial.radius_join(points(spark, sf).select("protein_key", "point_id", "x", "y", "z"), residues(spark, sf).select("protein_key", "residue_uid", "rsa", "x", "y", "z"), "protein_key", 11.3, spread="right")
    w = F.when(F.col("d2") <= 36, falloff(F.sqrt("d2")))
    return near.groupBy("point_id").agg(rounded(F.sum(w), 5).alias("weight"), rounded(F.sum(w * F.col("rsa")), 5).alias("rsa_sum"), F.count(w).alias("atoms"), F.count("*").alias("protrusion"))


@query(f"""WITH {PTS}, {RES},
r AS (SELECT a.residue_uid, b.point_id, {D2} AS d2, row_number() OVER (PARTITION BY a.residue_uid ORDER BY {D2}, b.point_id) AS r FROM res a JOIN pts b ON a.protein_key = b.protein_key)
SELECT residue_uid, point_id, round(sqrt(d2), 6) AS distance FROM r WHERE r = 1""")
def nearest_point(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest point of each residue."""
    near = spatial.nearest_join(residues(spark, sf).select("protein_key", "residue_uid", "x", "y", "z"), points(spark, sf).select("protein_key", "point_id", "x", "y", "z"), "protein_key", "residue_uid", "point_id", 6.0)
    return near.select("residue_uid", "point_id", rounded(F.sqrt("d2"), 6).alias("distance"))


@query(f"""WITH {PTS}, {RES}
SELECT residue_uid, CASE WHEN EXISTS (SELECT 1 FROM pts b WHERE b.label = 1 AND a.protein_key = b.protein_key AND {D2} <= 16.0) THEN 1 ELSE 0 END AS label FROM res a""")
def ligand_label(spark: SparkSession, sf: str) -> DataFrame:
    """A residue is labelled if a positive point lies within 4 A."""
    rows = residues(spark, sf).select("protein_key", "residue_uid", "x", "y", "z")
    hit = spatial.radius_join(rows, points(spark, sf).where("label = 1").select("protein_key", "point_id", "x", "y", "z"), "protein_key", 4.0)
    return rows.join(hit.select("residue_uid").distinct().withColumn("hit", F.lit(1)), "residue_uid", "left").select("residue_uid", F.coalesce("hit", F.lit(0)).alias("label"))


def _knn(spark: SparkSession, sf: str, k: int, exclude: bool = True, radius: float = 8.0) -> DataFrame:
    rows = materialize(residues(spark, sf), "residues")
    left = rows.select("protein_key", "residue_uid", F.col("res_id").alias("own"), "x", "y", "z")
    right = rows.select("protein_key", F.col("residue_uid").alias("other"), "res_id", "x", "y", "z")
    return spatial.knn_join(left, right, "protein_key", "residue_uid", "other", k, radius, F.col("own") != F.col("res_id") if exclude else None)


@query(f"""WITH {RES},
r AS (SELECT a.residue_uid, b.residue_uid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.residue_uid ORDER BY {D2}, b.residue_uid) AS rank
  FROM res a JOIN res b ON a.protein_key = b.protein_key AND a.res_id <> b.res_id)
SELECT residue_uid, other, CAST(rank AS INT) AS rank, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= 3""")
def knn3(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest residues of another number."""
    return _knn(spark, sf, 3).select("residue_uid", "other", "rank", rounded(F.sqrt("d2"), 6).alias("distance"))


@query(f"""WITH {RES},
r AS (SELECT a.residue_uid, b.residue_uid AS other, abs(a.res_id - b.res_id) AS step, row_number() OVER (PARTITION BY a.residue_uid ORDER BY abs(a.res_id - b.res_id), b.residue_uid) AS rank
  FROM res a JOIN res b ON a.protein_key = b.protein_key AND a.res_id <> b.res_id)
SELECT residue_uid, other, CAST(rank AS INT) AS rank, CAST(step AS INT) AS step FROM r WHERE rank <= 3""")
def sequence_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest residues along the chain: the distance is the difference of numbers."""
    line = residues(spark, sf).select("protein_key", "residue_uid", "res_id", F.col("res_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    left = line.withColumnRenamed("res_id", "own")
    near = spatial.knn_join(left, line.withColumnRenamed("residue_uid", "other"), "protein_key", "residue_uid", "other", 3, 3.0, F.col("own") != F.col("res_id"))
    return near.select("residue_uid", "other", "rank", F.sqrt("d2").cast("int").alias("step"))


ALL_RES = """ar AS (SELECT DISTINCT residue_uid, protein_key, res_id, xyz[1] AS x, xyz[2] AS y, xyz[3] AS z,
  coalesce(xyz[1] IS NOT NULL AND xyz[2] IS NOT NULL AND xyz[3] IS NOT NULL, false) AS placed FROM residues WHERE res_id IS NOT NULL)"""


@query(f"""WITH {ALL_RES},
r AS (SELECT a.residue_uid, b.residue_uid AS other, abs(a.res_id - b.res_id) AS step,
    row_number() OVER (PARTITION BY a.residue_uid ORDER BY CASE WHEN b.placed THEN {D2} ELSE (abs(a.res_id - b.res_id) + 1000.0) * (abs(a.res_id - b.res_id) + 1000.0) END, b.residue_uid) AS rank
  FROM ar a JOIN ar b ON a.protein_key = b.protein_key WHERE a.placed)
SELECT residue_uid, other, CAST(rank AS INT) AS rank, CAST(step AS INT) AS step FROM r WHERE rank <= 3""")
def mixed_distance_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest by place, residues without one ranked at their sequence distance plus 1000; itself counts; the distance told is that along the chain."""
    from voxelmill.sources.tables import table

    rows = table(spark, sf, "residues").where("res_id IS NOT NULL").select("residue_uid", "protein_key", "res_id", F.get("xyz", F.lit(0)).alias("x"), F.get("xyz", F.lit(1)).alias("y"), F.get("xyz", F.lit(2)).alias("z")).distinct()
    placed = rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    left = placed.withColumnRenamed("res_id", "own")
    near = spatial.knn_join(left, placed.select("protein_key", F.col("residue_uid").alias("other"), "x", "y", "z"), "protein_key", "residue_uid", "other", 3, 8.0)
    # those without a place come next, by sequence
    flat = lambda df: df.select("protein_key", "residue_uid", F.col("res_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    away = spatial.knn_join(flat(placed), flat(rows.where("x IS NULL OR y IS NULL OR z IS NULL")).withColumnRenamed("residue_uid", "other"), "protein_key", "residue_uid", "other", 3, 64.0)
    both = near.select("residue_uid", "other", "d2").union(away.select("residue_uid", "other", (F.sqrt("d2") + 1000) * (F.sqrt("d2") + 1000)))
    top = both.withColumn("rank", F.row_number().over(Window.partitionBy("residue_uid").orderBy("d2", "other"))).where("rank <= 3")
    number = rows.select("residue_uid", "res_id")
    return top.join(number, "residue_uid").join(number.select(F.col("residue_uid").alias("other"), F.col("res_id").alias("o")), "other").select("residue_uid", "other", "rank", F.abs(F.col("res_id") - F.col("o")).alias("step"))


@query(f"""WITH {RES},
r AS (SELECT a.protein_key, a.residue_uid AS a, b.residue_uid AS b, {D2} AS d2, row_number() OVER (PARTITION BY a.residue_uid ORDER BY {D2}, b.residue_uid) AS rank FROM res a JOIN res b ON a.protein_key = b.protein_key),
e AS (SELECT protein_key, a, b FROM r WHERE rank <= 16 AND d2 <= 64.0 AND a <> b)
SELECT * FROM e UNION SELECT protein_key, b, a FROM e""")
def knn_radius_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Residue graph: the 16 nearest, itself among them, cut at 8 A, made symmetric."""
    return knn_graph(_graph_neighbours(spark, sf), "protein_key", "residue_uid", "other", 8.0)


def _graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 16 nearest within 8 A suffice for a graph cut there, so the radius isn't widened."""
    rows = materialize(residues(spark, sf).select("protein_key", "residue_uid", "x", "y", "z").distinct(), "residues")
    near = spatial.radius_join(rows.select("protein_key", "residue_uid", "x", "y", "z"), rows.select("protein_key", F.col("residue_uid").alias("other"), "x", "y", "z"), "protein_key", 8.0)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("residue_uid").orderBy("d2", "other"))).where("rank <= 16")


@query(f"""WITH {PTS}, {RES},
hit AS (SELECT DISTINCT a.point_id FROM pts a JOIN res b ON a.protein_key = b.protein_key AND {D2} <= 16.0)
SELECT protein_key, count(*) AS points, count(hit.point_id) AS near, round(count(hit.point_id) / count(*), 6) AS share FROM pts LEFT JOIN hit ON pts.point_id = hit.point_id GROUP BY protein_key""")
def spatial_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a protein's points that have a residue within 4 A."""
    rows = points(spark, sf).select("protein_key", "point_id", "x", "y", "z")
    hit = spatial.radius_join(rows, residues(spark, sf).select("protein_key", "residue_uid", "x", "y", "z"), "protein_key", 4.0, spread="right").select("point_id").distinct().withColumn("hit", F.lit(1))
    out = rows.join(hit, "point_id", "left").groupBy("protein_key").agg(F.count("*").alias("points"), F.count("hit").alias("near"))
    return out.withColumn("share", rounded(F.col("near") / F.col("points"), 6))


@query(f"""WITH {RES}, ball AS (SELECT protein_key, residue_uid AS owner, x, y, z, 1.8 AS r FROM res),
smp AS (SELECT protein_key, owner, k, x + r*cos(th)*sqrt(greatest(0.0, 1-yy*yy)) AS x, y + r*yy AS y, z + r*sin(th)*sqrt(greatest(0.0, 1-yy*yy)) AS z
  FROM (SELECT ball.*, k, 1 - 2.0*k/(n-1) AS yy, 2*3.141592653589793/1.618033988749895*k AS th FROM (SELECT *, greatest(10, CAST(trunc(r*r*5.0) AS INT)) AS n FROM ball) ball, unnest(generate_series(0, n-1)) AS s(k)))
SELECT owner, count(*) AS exposed FROM smp a WHERE NOT EXISTS (SELECT 1 FROM ball b WHERE a.protein_key = b.protein_key AND a.owner <> b.owner AND {D2} < b.r*b.r) GROUP BY owner""")
def surface_occlusion(spark: SparkSession, sf: str) -> DataFrame:
    """Sphere points of each residue that lie inside no other residue's sphere."""
    balls = residues(spark, sf).select("protein_key", F.col("residue_uid").alias("owner"), "x", "y", "z", F.lit(1.8).alias("r"))
    free = spatial.exposure(balls, "protein_key", "owner", 5.0, 1.8).where("exposed > 0")
    return free.groupBy("owner").agg(F.sum("exposed").alias("exposed"))


@query(f"""WITH {RES},
r AS (SELECT a.residue_uid, b.residue_uid AS other, b.rsa, greatest(sqrt({D2}), 1e-4) AS d, row_number() OVER (PARTITION BY a.residue_uid ORDER BY {D2}, b.residue_uid) AS rank
  FROM res a JOIN res b ON a.protein_key = b.protein_key AND a.res_id <> b.res_id WHERE b.rsa IS NOT NULL)
SELECT residue_uid, round(sum(exp(-d/2)*rsa)/sum(exp(-d/2)), 6) AS softmax, round(sum(rsa/d)/(sum(1/d)+1e-8), 6) AS inverse, round(avg(rsa), 6) AS uniform FROM r WHERE rank <= 3 GROUP BY residue_uid""")
def knn_embedding_agg(spark: SparkSession, sf: str) -> DataFrame:
    """A neighbour value averaged over the three nearest residues by softmax, inverse and equal weights."""
    rows = residues(spark, sf)
    right = rows.where("rsa IS NOT NULL").select("protein_key", F.col("residue_uid").alias("other"), "res_id", "rsa", "x", "y", "z")
    near = spatial.knn_join(rows.select("protein_key", "residue_uid", F.col("res_id").alias("own"), "x", "y", "z"), right, "protein_key", "residue_uid", "other", 3, 8.0, F.col("own") != F.col("res_id"))
    lists = near.join(right.select("other", "rsa"), "other").groupBy("residue_uid").agg(F.collect_list(F.struct(F.sqrt("d2").alias("d"), "rsa")).alias("n"))
    mean = lambda mode: rounded(F.aggregate(F.zip_with(neighbour_weights(F.col("n.d"), mode), F.col("n.rsa"), lambda w, v: w * v), F.lit(0.0), lambda s, v: s + v), 6).alias(mode)
    return lists.select("residue_uid", mean("softmax"), mean("inverse"), mean("uniform"))
