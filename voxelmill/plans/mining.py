"""Hard examples, selections, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelmill.functions.expressions import rounded
from voxelmill.operators import metrics as M, sampling
from voxelmill.plans.pockets import BASE, FULL, _both, _nearest_pockets, compared, pockets
from voxelmill.plans.registry import PTS, RES, SCORED, points, query, residues, scored
from voxelmill.sources import sinks
from voxelmill.sources.tables import table
from voxelmill.storage import materialize

BUCKET = "CASE WHEN y = 1 AND (p < 0.88 OR abs(p - 0.88) <= 0.15) THEN 'positive' WHEN y = 0 AND p >= 0.88 - 0.12 THEN 'border' WHEN y = 0 AND p <= 0.05 THEN 'safe' ELSE 'other' END"


def _bucket():
    p, y = F.col("p"), F.col("y")
    return F.when((y == 1) & ((p < 0.88) | (F.abs(p - 0.88) <= 0.15)), "positive").when((y == 0) & (p >= 0.88 - 0.12), "border").when((y == 0) & (p <= 0.05), "safe").otherwise("other")


@query(f"WITH {SCORED} SELECT point_id, {BUCKET} AS bucket FROM scored")
def uncertainty_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Uncertain positives, border negatives and safe negatives."""
    return scored(spark, sf).select("point_id", _bucket().alias("bucket"))


@query(f"WITH {SCORED} SELECT protein_key, point_id, p FROM scored WHERE y = 1 AND p < 0.88")
def hard_positives(spark: SparkSession, sf: str) -> DataFrame:
    """Positives below the threshold."""
    return scored(spark, sf).where("y = 1 AND p < 0.88").select("protein_key", "point_id", "p")


UNDER = f"""{SCORED}, iou AS (SELECT protein_key, count(*) FILTER (WHERE p >= 0.88 AND y = 1) / greatest(1, count(*) FILTER (WHERE p >= 0.88 OR y = 1)) AS iou FROM scored GROUP BY protein_key),
under AS (SELECT protein_key FROM iou ORDER BY iou, protein_key LIMIT 20)"""


def _under(rows: DataFrame, k: int = 20) -> DataFrame:
    """The k proteins of the least IoU."""
    both = F.count(F.when((F.col("p") >= 0.88) & (F.col("y") == 1), 1)) / F.greatest(F.lit(1), F.count(F.when((F.col("p") >= 0.88) | (F.col("y") == 1), 1)))
    return rows.groupBy("protein_key").agg(both.alias("iou")).orderBy("iou", "protein_key").limit(k)


@query(f"WITH {UNDER} SELECT protein_key, round(iou, 6) AS iou FROM iou WHERE protein_key IN (SELECT protein_key FROM under)")
def underperformers(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty proteins of the least IoU."""
    return _under(scored(spark, sf)).select("protein_key", rounded(F.col("iou"), 6).alias("iou"))


@query(f"""WITH {UNDER}, b AS (SELECT point_id, {BUCKET} AS bucket, CASE WHEN protein_key IN (SELECT protein_key FROM under) THEN 0 ELSE 1 END AS pool, abs(p - 0.88) AS margin FROM scored)
SELECT point_id, CAST(pool AS INT) AS pool, round(margin, 6) AS margin FROM b WHERE bucket = 'positive' ORDER BY b.pool, b.margin, point_id LIMIT 200""")
def curated_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Two hundred uncertain positives, those of weak proteins first, then by margin."""
    rows = scored(spark, sf)
    weak = F.broadcast(_under(rows).select("protein_key", F.lit(0).alias("w")))  # twenty rows
    pooled = rows.where(_bucket() == "positive").join(weak, "protein_key", "left").select("point_id", F.coalesce("w", F.lit(1)).alias("pool"), F.abs(F.col("p") - 0.88).alias("margin"))
    return sampling.prioritised(pooled, "pool", "margin", "point_id", 200).select("point_id", "pool", rounded(F.col("margin"), 6).alias("margin"))


@query(f"WITH {SCORED}, b AS (SELECT point_id, {BUCKET} AS bucket FROM scored), r(bucket, n) AS (VALUES ('positive', 3), ('border', 2), ('safe', 1)) SELECT point_id, bucket, CAST(unnest(generate_series(1, n)) AS INT) AS copy FROM b JOIN r USING (bucket)")
def oversample_union(spark: SparkSession, sf: str) -> DataFrame:
    """Positives three times, border negatives twice, safe negatives once."""
    rows = scored(spark, sf).select("point_id", _bucket().alias("bucket")).where("bucket <> 'other'")
    return sampling.repeat(rows, F.when(F.col("bucket") == "positive", 3).when(F.col("bucket") == "border", 2).otherwise(1))


@query(f"WITH {SCORED} SELECT point_id FROM scored WHERE y = 0 AND p <= 0.05 ORDER BY md5('0:' || CAST(point_id AS VARCHAR)), point_id LIMIT 300")
def safe_negative_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Three hundred safe negatives, a sample without replacement that is the same on every run."""
    return sampling.sample(scored(spark, sf).where("y = 0 AND p <= 0.05").select("point_id"), "point_id", 300)


@query("""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, split, label FROM sample_store), t AS (SELECT sample_id FROM s WHERE split = 0), h AS (SELECT sample_id FROM s WHERE label = 1)
SELECT sample_id, CAST(unnest(generate_series(1, CASE WHEN sample_id IN (SELECT sample_id FROM h) THEN 3 ELSE 1 END)) AS INT) AS copy FROM t""")
def hard_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Training samples, the listed hard ones two times more."""
    rows = table(spark, sf, "sample_store").select("sample_id", "split", "label").dropDuplicates(["sample_id"])
    hard = rows.where("label = 1").select("sample_id", F.lit(3).alias("n"))
    return sampling.repeat(rows.where("split = 0").select("sample_id").join(hard, "sample_id", "left"), F.coalesce("n", F.lit(1))).select("sample_id", "copy")


@query(f"""WITH {PTS}, l AS (SELECT 'x' AS feature, x AS v FROM pts UNION ALL SELECT 'y', y FROM pts UNION ALL SELECT 'z', z FROM pts UNION ALL SELECT 'prob', prob FROM pts)
SELECT feature, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, min(v) AS least, round(quantile_cont(v, 0.25), 5) AS q1, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q3, max(v) AS most, count(DISTINCT v) AS values FROM l GROUP BY feature""")
def feature_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Moments, quartiles, extremes and distinct values of each feature."""
    rows = materialize(points(spark, sf).select("x", "y", "z", "prob"), "points").select(F.expr("stack(4, 'x', x, 'y', y, 'z', z, 'prob', prob) AS (feature, v)"))
    sums = rows.groupBy("feature").agg(rounded(F.avg("v"), 5).alias("mean"), rounded(F.stddev_samp("v"), 5).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
    # distinct values are told apart by ranges, so that no task holds those of a feature
    distinct = rows.groupBy("feature", "v").agg(F.lit(1).alias("one")).groupBy("feature").agg(F.count("*").alias("values"))
    told = M.quantiles(rows, ["feature"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return sums.join(distinct, "feature").join(told, "feature").select("feature", "n", "mean", "std", "least", *[rounded(F.col(c), 5).alias(c) for c in ("q1", "median", "q3")], "most", "values")


@query("SELECT residue_name AS value, count(*) AS n, count(DISTINCT protein_key) AS proteins FROM sas_points GROUP BY residue_name")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and proteins of each residue name."""
    return table(spark, sf, "sas_points").groupBy(F.col("residue_name").alias("value")).agg(F.count("*").alias("n"), F.countDistinct("protein_key").alias("proteins"))


NULLS = ("chain_id", "label", "prob", "x", "y", "z", "residue_name")


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in NULLS) + ", count(*) FILTER (WHERE isnan(prob)) AS nan_prob, count(*) FILTER (WHERE isnan(x) OR isnan(y) OR isnan(z)) AS nan_place FROM sas_points")
def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls and NaNs by column, in one scan."""
    nan = lambda c: F.coalesce(F.isnan(c), F.lit(False))
    return table(spark, sf, "sas_points").agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in NULLS], F.count(F.when(nan("prob"), 1)).alias("nan_prob"), F.count(F.when(nan("x") | nan("y") | nan("z"), 1)).alias("nan_place"))


@query("""WITH s AS (SELECT DISTINCT ON (sample_id) sample_id, tabular FROM sample_store), l AS (SELECT unnest(range(len(tabular))) AS k, unnest(tabular) AS v FROM s)
SELECT CAST(k AS INT) AS feature, count(*) AS n, round(avg(CAST(v AS DOUBLE)), 4) AS mean, count(*) FILTER (WHERE v <> 0) AS filled FROM l GROUP BY k""")
def tabular_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and filled values of each of a sample's 35 descriptors."""
    long = table(spark, sf, "sample_store").select("sample_id", "tabular").dropDuplicates(["sample_id"]).select(F.posexplode("tabular").alias("feature", "v"))
    return long.groupBy("feature").agg(F.count("*").alias("n"), rounded(F.avg(F.col("v").cast("double")), 4).alias("mean"), F.count(F.when(F.col("v") != 0, 1)).alias("filled"))


@query(f"{BASE} SELECT protein_key, count(*) AS pockets, round(sum(score), 5) AS score_sum, max(score) AS best_score, round(avg(sample_points), 6) AS mean_points FROM ranked GROUP BY protein_key")
def per_protein_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Pockets of each protein."""
    return pockets(spark, sf).ranked.groupBy("protein_key").agg(F.count("*").alias("pockets"), rounded(F.sum("score"), 5).alias("score_sum"), F.max("score").alias("best_score"), rounded(F.avg("sample_points"), 6).alias("mean_points"))


RUN = ("proteins", "pockets", "pockets_per_protein", "mean_score", "mean_points", "mean_surface")


@query(f"""{BASE}, one AS (SELECT count(DISTINCT protein_key) AS proteins, count(*) AS pockets, round(count(*)/count(DISTINCT protein_key), 6) AS pockets_per_protein, round(avg(score), 5) AS mean_score, round(avg(sample_points), 6) AS mean_points, round(avg(surface_atoms), 6) AS mean_surface FROM ranked)
""" + " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM one" for c in RUN))
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The run's metrics as rows."""
    r = pockets(spark, sf).ranked
    one = r.agg(F.countDistinct("protein_key").alias("proteins"), F.count("*").alias("pockets"), rounded(F.count("*") / F.countDistinct("protein_key"), 6).alias("pockets_per_protein"), rounded(F.avg("score"), 5).alias("mean_score"), rounded(F.avg("sample_points"), 6).alias("mean_points"), rounded(F.avg("surface_atoms"), 6).alias("mean_surface"))
    return sinks.metric_rows(one, RUN)


@query(f"""{FULL}, b AS (SELECT protein_key, max(iou) AS best FROM cmp GROUP BY protein_key), s AS (SELECT *, row_number() OVER (ORDER BY best DESC, protein_key) AS up, row_number() OVER (ORDER BY best, protein_key) AS down FROM b)
SELECT protein_key, best, 'success' AS kind FROM s WHERE up <= 5 UNION ALL SELECT protein_key, best, 'failure' FROM s WHERE up > 5 AND down <= 5""")
def case_studies(spark: SparkSession, sf: str) -> DataFrame:
    """Five proteins of the best IoU and five others of the worst."""
    truth = compared(spark, sf)
    best = _both(truth).join(truth.pairs.groupBy("protein_key").agg(F.max("iou").alias("best")), "protein_key", "left").fillna(0.0, ["best"])
    best = materialize(best, "best")
    up = best.orderBy(F.desc("best"), "protein_key").limit(5)
    down = best.orderBy("best", "protein_key").limit(5).join(up.select("protein_key"), "protein_key", "left_anti")
    return up.withColumn("kind", F.lit("success")).unionByName(down.withColumn("kind", F.lit("failure")))


@query("""WITH p AS (SELECT DISTINCT ON (pocket_id) * FROM pockets) SELECT coalesce(file_name, '') AS file, coalesce(pocket, '') AS pocket, coalesce(CAST(CAST(rank AS INT) AS VARCHAR), '') AS rank, CASE WHEN score IS NULL THEN '' WHEN isnan(score) THEN 'NaN' ELSE printf('%.6f', score) END AS score,
  CASE WHEN pocket_volume IS NULL THEN '' WHEN isnan(pocket_volume) THEN 'NaN' ELSE printf('%.6f', pocket_volume) END AS "pocketVolume", CAST(surface_atoms AS VARCHAR) AS "surfaceAtoms" FROM p""")
def pocket_file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the pocket file."""
    rows = sinks.pocket_file(table(spark, sf, "pockets").dropDuplicates(["pocket_id"]))
    return rows.select("file", "pocket", "rank", "score", "pocketVolume", "surfaceAtoms")


@query(f"WITH {RES}, r AS (SELECT protein_key, count(*) AS n, count(*) FILTER (WHERE prob >= 0.5) AS hot, count(*) FILTER (WHERE rsa >= 0.2) AS exposed FROM res GROUP BY protein_key) SELECT protein_key, n, hot, exposed, round(hot/n, 6) AS density FROM r")
def residue_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Residues of each protein, the probable and the exposed."""
    r = residues(spark, sf).groupBy("protein_key").agg(F.count("*").alias("n"), F.count(F.when(F.col("prob") >= 0.5, 1)).alias("hot"), F.count(F.when(F.col("rsa") >= 0.2, 1)).alias("exposed"))
    return r.withColumn("density", rounded(F.col("hot") / F.col("n"), 6))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly sums of events, the batch form of the streaming query."""
    from voxelmill.streaming.events import hourly

    w = hourly(table(spark, sf, "events"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user, parted by more than 30 minutes."""
    from voxelmill.streaming.events import sessions

    s = sessions(table(spark, sf, "events"))
    return s.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("started"), "n", rounded(F.col("total"), 4).alias("total"))


@query(f"""{FULL}, g AS (SELECT site_id, rank, (gx-cx)*(gx-cx) + (gy-cy)*(gy-cy) + (gz-cz)*(gz-cz) AS d2 FROM ranked JOIN gs ON ranked.protein_key = gs.protein_key),
d AS (SELECT site_id, round(sqrt(min(d2)), 4) AS d, arg_min(rank, (d2, rank)) AS r FROM g GROUP BY site_id) SELECT CAST(r AS INT) AS rank, count(*) AS sites, count(*) FILTER (WHERE d <= 4) AS near FROM d GROUP BY r""")
def nearest_rank_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Which rank the pocket nearest to each site has."""
    d = _nearest_pockets(pockets(spark, sf, keep=True))
    return d.groupBy("rank").agg(F.count("*").alias("sites"), F.count(F.when(F.col("distance") <= 4, 1)).alias("near"))
