"""Padding, masks, set conventions, batch scores and what else joins the parts together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelmill.functions.expressions import rounded
from voxelmill.functions.keys import entry_code, entry_code_sql
from voxelmill.operators import metrics as M, scoring
from voxelmill.plans.pockets import BASE, GREEDY, _matches, compared, pockets
from voxelmill.plans.metrics import kth_and_percentiles
from voxelmill.plans.registry import PTS, RES, SCORED, points, query, residues, scored
from voxelmill.plans.spatial import D2, _knn
from voxelmill.sources.tables import table
from voxelmill.storage import materialize

STORE = "store AS (SELECT DISTINCT ON (sample_id) * FROM sample_store)"


def store(spark: SparkSession, sf: str) -> DataFrame:
    """Samples, repeated rows once."""
    return table(spark, sf, "sample_store").dropDuplicates(["sample_id"])


@query(f"""WITH {RES}, r AS (SELECT a.residue_uid, b.residue_uid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.residue_uid ORDER BY {D2}, b.residue_uid) AS rank
  FROM res a JOIN res b ON a.protein_key = b.protein_key AND a.res_id <> b.res_id), k AS (SELECT unnest([1, 2, 3]) AS k)
SELECT res.residue_uid, CAST(k AS INT) AS rank, coalesce(other, res.residue_uid) AS other, round(coalesce(sqrt(d2), 0), 6) AS distance FROM res CROSS JOIN k LEFT JOIN r ON r.residue_uid = res.residue_uid AND r.rank = k""")
def knn_padded(spark: SparkSession, sf: str) -> DataFrame:
    """Three neighbours for every residue; where there are fewer, itself at distance 0."""
    near = _knn(spark, sf, 3).select("residue_uid", "rank", "other", "d2")
    slots = residues(spark, sf).select("residue_uid", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    return slots.join(near, ["residue_uid", "rank"], "left").select("residue_uid", "rank", F.coalesce("other", "residue_uid").alias("other"), rounded(F.coalesce(F.sqrt("d2"), F.lit(0.0)), 6).alias("distance"))


@query(f"""WITH {RES}, r AS (SELECT a.residue_uid, b.residue_uid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.residue_uid ORDER BY {D2}, b.residue_uid) AS rank
  FROM res a JOIN res b ON a.protein_key = b.protein_key AND a.res_id <> b.res_id), k AS (SELECT unnest([1, 2, 3]) AS k), l AS (SELECT protein_key, arg_max(residue_uid, (res_id, residue_uid)) AS last FROM res WHERE res_id IS NOT NULL GROUP BY protein_key)
SELECT res.residue_uid, CAST(k AS INT) AS rank, coalesce(other, last) AS other, round(coalesce(sqrt(d2), 999), 6) AS distance FROM res CROSS JOIN k LEFT JOIN r ON r.residue_uid = res.residue_uid AND r.rank = k LEFT JOIN l ON l.protein_key = res.protein_key""")
def knn_padded_last(spark: SparkSession, sf: str) -> DataFrame:
    """Three neighbours for every residue; where there are fewer, the last of its protein at 999."""
    near = _knn(spark, sf, 3).select("residue_uid", "rank", "other", "d2")
    rows = residues(spark, sf)
    last = rows.where("res_id IS NOT NULL").groupBy("protein_key").agg(F.max(F.struct("res_id", "residue_uid")).alias("l")).select("protein_key", F.col("l.residue_uid").alias("last"))
    slots = rows.select("protein_key", "residue_uid", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank")).join(last, "protein_key", "left")
    return slots.join(near, ["residue_uid", "rank"], "left").select("residue_uid", "rank", F.coalesce("other", "last").alias("other"), rounded(F.coalesce(F.sqrt("d2"), F.lit(999.0)), 6).alias("distance"))


@query(f"""WITH {STORE}, n AS (SELECT sample_id, CAST(unnest(neighbor_distances) AS DOUBLE) AS d FROM store)
SELECT sample_id, count(*) AS n, count(*) FILTER (WHERE isfinite(d) AND d < 999) AS valid, count(*) FILTER (WHERE isfinite(d) AND d < 1e6) AS finite, round(avg(CASE WHEN isfinite(d) AND d < 999 THEN d ELSE 30 END), 5) AS mean_distance FROM n GROUP BY sample_id""")
def neighbour_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Stored neighbours that are valid (a distance under 999, which stands for none), those that a mask of 1e6 passes, and the mean distance with 30 for the others."""
    d = F.col("d").cast("double")
    ok = ~F.isnan(d) & (F.abs(d) < float("inf")) & (d < 999)
    n = store(spark, sf).select("sample_id", F.explode("neighbor_distances").alias("d"))
    return n.groupBy("sample_id").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~F.isnan(d) & (F.abs(d) < 1e6), 1)).alias("finite"), rounded(F.avg(F.when(ok, d).otherwise(30.0)), 5).alias("mean_distance"))


@query(f"""{BASE}, p AS (SELECT protein_key, count(*) AS n, sum(sample_points) AS members FROM ranked GROUP BY protein_key), a AS (SELECT protein_key, count(*) AS points FROM pts GROUP BY protein_key)
SELECT a.protein_key, coalesce(n, 0) AS pockets, round(coalesce(members, 0) / points, 6) AS coverage FROM a LEFT JOIN p ON a.protein_key = p.protein_key""")
def pocket_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Pockets of each protein and the share of its points in them, those in several counted for each."""
    pts, _, ranked, _ = pockets(spark, sf)
    p = ranked.groupBy("protein_key").agg(F.count("*").alias("n"), F.sum("sample_points").alias("members"))
    a = pts.groupBy("protein_key").agg(F.count("*").alias("points"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(p, "protein_key", "left").select("protein_key", zero("n").alias("pockets"), rounded(zero("members") / F.col("points"), 6).alias("coverage"))


@query(f"{BASE} SELECT count(*) AS pockets, round(avg(sample_points), 6) AS mean_size, round(stddev_pop(sample_points), 6) AS std_size, min(sample_points) AS least_size, max(sample_points) AS most_size, round(sum(score), 4) AS score_sum FROM ranked")
def pocket_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and scores of all pockets."""
    n = F.col("sample_points")
    return pockets(spark, sf).ranked.agg(F.count("*").alias("pockets"), rounded(F.avg(n), 6).alias("mean_size"), rounded(F.stddev_pop(n), 6).alias("std_size"), F.min(n).alias("least_size"), F.max(n).alias("most_size"), rounded(F.sum("score"), 4).alias("score_sum"))


@query(f"{GREEDY} SELECT count(*) AS matches, round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.5), 6) AS median_iou, round(stddev_pop(iou), 6) AS std_iou FROM match")
def match_iou_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median and deviation of the IoU of all greedy matches."""
    m = materialize(_matches(compared(spark, sf)), "match")
    median = M.quantiles(m, [], "iou", {"q": 0.5}).select(rounded(F.col("q"), 6)).scalar()
    return m.agg(F.count("*").alias("matches"), rounded(F.avg("iou"), 6).alias("mean_iou"), rounded(F.stddev_pop("iou"), 6).alias("std_iou")).withColumn("median_iou", median)


@query(f"""WITH {SCORED}, s AS (SELECT protein_key, count(*) FILTER (WHERE p >= 0.97 AND y = 1) AS i, count(*) FILTER (WHERE p >= 0.97 OR y = 1) AS u FROM scored GROUP BY protein_key)
SELECT protein_key, round(CASE WHEN u = 0 THEN 0.0 ELSE i/u END, 6) AS empty_is_zero, round(CASE WHEN u = 0 THEN 1.0 ELSE i/u END, 6) AS empty_is_one, round(i/(u+1e-8), 6) AS with_epsilon, CASE WHEN u > 0 THEN round(i/u, 6) END AS empty_is_null FROM s""")
def iou_conventions(spark: SparkSession, sf: str) -> DataFrame:
    """IoU under the four readings of two empty sets."""
    on, pos = F.col("p") >= 0.97, F.col("y") == 1
    s = scored(spark, sf).groupBy("protein_key").agg(F.count(F.when(on & pos, 1)).alias("i"), F.count(F.when(on | pos, 1)).alias("u"))
    iou, none = F.col("i") / F.col("u"), F.col("u") == 0
    return s.select("protein_key", rounded(F.when(none, 0.0).otherwise(iou), 6).alias("empty_is_zero"), rounded(F.when(none, 1.0).otherwise(iou), 6).alias("empty_is_one"), rounded(F.col("i") / (F.col("u") + 1e-8), 6).alias("with_epsilon"), F.when(~none, rounded(iou, 6)).alias("empty_is_null"))


@query(f"""WITH RECURSIVE {RES}, o AS (SELECT residue_uid, protein_key, prob AS p, lead(prob) OVER w AS b, row_number() OVER w AS r FROM res WHERE prob IS NOT NULL WINDOW w AS (PARTITION BY protein_key ORDER BY res_id, residue_uid)),
walk AS (SELECT protein_key, r, residue_uid, p AS s FROM o WHERE r = 1
  UNION ALL SELECT o.protein_key, o.r, o.residue_uid, CASE WHEN o.b IS NULL THEN o.p ELSE 0.7 * o.p + 0.15 * (walk.s + o.b) END FROM walk JOIN o ON o.protein_key = walk.protein_key AND o.r = walk.r + 1)
SELECT residue_uid, round(s, 6) AS smoothed FROM walk""")
def chain_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Along a chain s(i) = 0.7 p(i) + 0.15 (s(i-1) + p(i+1)), the ends untouched.

    What lies k places back weighs 0.15^k, so 24 places give every digit of a
    double and no task walks a chain.
    """
    w = Window.partitionBy("protein_key").orderBy("res_id", "residue_uid")
    p = F.col("prob")
    rows = residues(spark, sf).where("prob IS NOT NULL").select("residue_uid", "protein_key", "res_id", "prob", F.lead("prob").over(w).alias("b"), F.lag("prob").over(w).isNull().alias("first"))
    own = rows.withColumn("c", F.when(F.col("first"), p).otherwise(0.7 * p + 0.15 * F.coalesce("b", p)))
    recent = F.collect_list("c").over(w.rowsBetween(-24, 0))
    return own.withColumn("n", recent).select("residue_uid", rounded(F.when(F.col("b").isNull(), p).otherwise(F.aggregate("n", F.lit(0.0), lambda s, c: 0.15 * s + c)), 6).alias("smoothed"))


@query(f"""WITH {SCORED}, q AS (SELECT protein_key, quantile_cont(p, 0.95) AS p95 FROM scored GROUP BY protein_key),
k AS (SELECT protein_key, p FROM (SELECT protein_key, p, row_number() OVER (PARTITION BY protein_key ORDER BY p DESC) AS r, count(*) OVER (PARTITION BY protein_key) AS n FROM scored) WHERE r = greatest(1, CAST(floor(n*0.03) AS BIGINT))),
m AS (SELECT q.protein_key, unnest(['global', 'adaptive', 'percentile']) AS mode, p95, k.p FROM q JOIN k ON q.protein_key = k.protein_key)
SELECT m.protein_key, mode, round(CASE mode WHEN 'global' THEN 0.5 WHEN 'adaptive' THEN m.p ELSE p95 END, 6) AS threshold, count(*) FILTER (WHERE s.p >= CASE mode WHEN 'global' THEN 0.5 WHEN 'adaptive' THEN m.p ELSE p95 END) AS kept
FROM m JOIN scored s ON m.protein_key = s.protein_key GROUP BY m.protein_key, mode, p95, m.p""")
def threshold_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds of the three modes and what each keeps."""
    rows = scored(spark, sf)
    per = kth_and_percentiles(rows, 0.03, {"p95": 0.95})
    modes = per.select("protein_key", F.explode(F.create_map(F.lit("global"), F.lit(0.5), F.lit("adaptive"), F.col("kth"), F.lit("percentile"), F.col("p95"))).alias("mode", "threshold"))
    kept = F.count(F.when(F.col("p") >= F.col("threshold"), 1))
    return modes.join(rows, "protein_key").groupBy("protein_key", "mode", "threshold").agg(kept.alias("kept")).select("protein_key", "mode", rounded(F.col("threshold"), 6).alias("threshold"), "kept")


@query(f"WITH {STORE} SELECT CAST(split AS INT) AS split, count(*) AS samples, count(DISTINCT lower(protein_key)) AS proteins, count(*) FILTER (WHERE label = 1) AS positives FROM store GROUP BY split")
def split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Samples, proteins and positives of each stored split."""
    return store(spark, sf).groupBy(F.col("split").cast("int").alias("split")).agg(F.count("*").alias("samples"), F.countDistinct(F.lower("protein_key")).alias("proteins"), F.count(F.when(F.col("label") == 1, 1)).alias("positives"))


ENTRY = entry_code_sql("protein_id")


@query(f"""WITH a AS (SELECT DISTINCT {ENTRY} AS e FROM train_ids WHERE {ENTRY} IS NOT NULL), b AS (SELECT DISTINCT {ENTRY} AS e FROM test_ids WHERE {ENTRY} IS NOT NULL)
SELECT e, 'both' AS side FROM (SELECT e FROM a INTERSECT SELECT e FROM b) UNION ALL SELECT e, 'train' FROM (SELECT e FROM a EXCEPT SELECT e FROM b) UNION ALL SELECT e, 'test' FROM (SELECT e FROM b EXCEPT SELECT e FROM a)""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of train and test: in both, and in one only."""
    a, b = (table(spark, sf, f"{n}_ids").select(entry_code(F.col("protein_id")).alias("e")).where("e IS NOT NULL") for n in ("train", "test"))
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.intersect(b), "both").union(side(a.subtract(b), "train")).union(side(b.subtract(a), "test"))


@query(f"""WITH {PTS}, {STORE} SELECT pts.protein_key, count(*) AS pairs, count(*) FILTER (WHERE pts.label = store.label) AS agree FROM pts JOIN store
  ON pts.protein_key = lower(split_part(store.protein_key, '_', 1)) || '_' || upper(split_part(store.protein_key, '_', 2)) AND pts.point_idx = store.point_idx GROUP BY pts.protein_key""")
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions and stored labels joined by protein and place."""
    parts = F.split("protein_key", "_")
    key = F.concat(F.lower(F.get(parts, F.lit(0))), F.lit("_"), F.upper(F.get(parts, F.lit(1))))
    right = store(spark, sf).select(key.alias("protein_key"), "point_idx", F.col("label").alias("stored"))
    return points(spark, sf).join(right, ["protein_key", "point_idx"]).groupBy("protein_key").agg(F.count("*").alias("pairs"), F.count(F.when(F.col("label") == F.col("stored"), 1)).alias("agree"))


@query(f"WITH {STORE} SELECT sample_id, unnest(neighbor_idx) AS idx, unnest(neighbor_resnums) AS resnum FROM store")
def neighbour_records(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays as records."""
    return store(spark, sf).select("sample_id", F.inline(F.arrays_zip(F.col("neighbor_idx").alias("idx"), F.col("neighbor_resnums").alias("resnum"))))


@query("WITH k AS (SELECT DISTINCT protein_no FROM proteins) SELECT CAST(protein_no % 4 AS INT) AS shard, count(*) AS proteins FROM k GROUP BY 1")
def worker_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All chains dealt to four workers by number."""
    return table(spark, sf, "proteins").select("protein_no").distinct().groupBy(F.pmod("protein_no", F.lit(4)).cast("int").alias("shard")).agg(F.count("*").alias("proteins"))


@query("""WITH e AS (SELECT label, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT CAST(k AS INT) AS k, round(sum(v*(label+1))/sum(label+1), 6) AS blended FROM e GROUP BY k""")
def weight_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors blended element by element with weights."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "v"))
    w = F.col("label") + 1
    return e.groupBy("k").agg(rounded(F.sum(F.col("v").cast("double") * w) / F.sum(w), 6).alias("blended"))


@query(f"WITH {STORE} SELECT sample_id, round(1/(1+exp(-list_avg(list_transform(tabular, lambda v: CAST(v AS DOUBLE))))), 6) AS score FROM store WHERE len(tabular) = 35")
def batch_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the default scorer, by Arrow batches."""
    rows = store(spark, sf).where("size(tabular) = 35")
    return scoring.score_batches(rows, "sample_id", "tabular", scoring.logistic_mean).select("sample_id", rounded(F.col("score"), 6).alias("score"))


@query(f"""WITH {PTS}, c AS (SELECT protein_key, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts WHERE label = 1 GROUP BY protein_key) SELECT protein_key, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM c""")
def ligand_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Centre of each protein's positive points."""
    return points(spark, sf).where("label = 1").groupBy("protein_key").agg(*[rounded(F.avg(a), 4).alias(a) for a in "xyz"])
