"""Thresholds, curves, class balance and score transforms over scored points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelmill.functions import expressions as X
from voxelmill.functions.expressions import rounded
from voxelmill.operators import metrics as M
from voxelmill.plans.registry import PKT, SCORED, query, ranked, scored
from voxelmill.storage import materialize

NINE = X.parse_thresholds("0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9")
GRID50 = [round(0.01 + 0.02 * k, 2) for k in range(50)]
GRID100 = [round(0.1 + 0.8 * k / 99, 12) for k in range(100)]


def _grid(values: list[float]) -> str:
    return "t AS (SELECT CAST(unnest([" + ", ".join(map(str, values)) + "]) AS DOUBLE) AS t)"


CONF = "c AS (SELECT t, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y <> 1) AS fp, count(*) FILTER (WHERE p < t AND y = 1) AS fn, count(*) FILTER (WHERE p < t AND y <> 1) AS tn FROM scored CROSS JOIN t GROUP BY t)"
PRF = "CASE WHEN tp+fp = 0 THEN 0.0 ELSE tp/(tp+fp) END", "CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp/(tp+fn) END", "CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2*tp/(2*tp+fp+fn) END"
INT = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn"


def _prf() -> list:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [rounded(M.ratio(tp, tp + fp), 6).alias("precision"), rounded(M.ratio(tp, tp + fn), 6).alias("recall"), rounded(M.ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1")]


@query(f"WITH {SCORED}, {_grid(NINE)}, {CONF} SELECT t AS threshold, {INT}, round({PRF[0]}, 6) AS precision, round({PRF[1]}, 6) AS recall, round({PRF[2]}, 6) AS f1 FROM c")
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 at nine thresholds, from one pass."""
    return M.threshold_counts(scored(spark, sf), NINE).select(F.col("t").alias("threshold"), "tp", "fp", "fn", "tn", *_prf())


@query(f"""WITH {SCORED}, t AS (SELECT 0.5::DOUBLE AS t), {CONF} SELECT round((tp+tn)/(tp+tn+fp+fn+1e-7), 6) AS accuracy, round(tp/(tp+fp+1e-7), 6) AS precision, round(tp/(tp+fn+1e-7), 6) AS recall,
  round(tn/(tn+fp+1e-7), 6) AS specificity, round(2*tp/(2*tp+fp+fn+1e-7), 6) AS f1, round(tp/(tp+fp+fn+1e-7), 6) AS iou, round((tp+fn)/(tp+tn+fp+fn+1e-7), 6) AS prevalence FROM c""")
def epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of an evaluation pass at 0.5, with 1e-7 in the denominators."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    e = 1e-7
    out = {"accuracy": (tp + tn) / (tp + tn + fp + fn + e), "precision": tp / (tp + fp + e), "recall": tp / (tp + fn + e), "specificity": tn / (tn + fp + e), "f1": 2 * tp / (2 * tp + fp + fn + e), "iou": tp / (tp + fp + fn + e), "prevalence": (tp + fn) / (tp + tn + fp + fn + e)}
    return M.threshold_counts(scored(spark, sf), [0.5]).select(*[rounded(v, 6).alias(k) for k, v in out.items()])


def _positives(steps: DataFrame) -> int:
    return steps.agg(F.sum("pos")).first()[0] or 0


STEPS = """v AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM scored GROUP BY p),
s AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM v)"""


@query(f"WITH {SCORED}, {STEPS} SELECT p AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp/(tp+fp), 6) AS precision, round(tp/(SELECT sum(pos) FROM v), 6) AS recall FROM s")
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall at every distinct score."""
    steps = materialize(M.score_steps(scored(spark, sf)), "steps")
    total = F.lit(_positives(steps))
    return steps.select(F.col("p").alias("score"), "tp", "fp", rounded(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), rounded(F.col("tp") / total, 6).alias("recall"))


@query(f"WITH {SCORED}, {STEPS} SELECT round(sum(pos*tp/(tp+fp))/sum(pos), 6) AS average_precision, round(sum(neg*(tp-pos/2))/(sum(pos)*sum(neg)), 6) AS auroc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(pos)+sum(neg) AS BIGINT) AS n FROM s")
def average_precision_auroc(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision with ties as one step, and the area under the ROC curve."""
    s = M.score_steps(scored(spark, sf))
    return s.agg(rounded(M.average_precision(s), 6).alias("average_precision"), rounded(M.auroc(s), 6).alias("auroc"), F.sum("pos").alias("positives"), (F.sum("pos") + F.sum("neg")).alias("n"))


@query(f"""WITH {SCORED}, {STEPS}, c AS (SELECT tp/(SELECT sum(pos) FROM v) AS x, tp/(tp+fp) AS h, lag(tp/(SELECT sum(pos) FROM v), 1, 0.0) OVER (ORDER BY p DESC) AS x0, lag(tp/(tp+fp), 1, 1.0) OVER (ORDER BY p DESC) AS h0 FROM s)
SELECT round(sum((x-x0)*(h+h0)/2), 6) AS area FROM c""")
def pr_trapezoid(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids from (0, 1).

    The value before a step is known from the step itself: tp - pos of fp - neg.
    """
    steps = materialize(M.score_steps(scored(spark, sf)), "steps")
    total = F.lit(_positives(steps))
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    h0 = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / (tp0 + fp0))
    h = F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.agg(rounded(F.sum(F.col("pos") / total * (h + h0) / 2), 6).alias("area"))


BEST = "{name} AS (SELECT t, v FROM (SELECT t, v FROM m UNION ALL SELECT 0.5, 0.0) WHERE v > 0 OR NOT EXISTS (SELECT 1 FROM m WHERE v > 0) ORDER BY v DESC, CASE WHEN v > 0 THEN t ELSE abs(t - 0.5) END LIMIT 1)"


def _best(counts: DataFrame, value) -> DataFrame:
    """``threshold, value``: the lowest threshold of the largest value; 0.5 where none is above 0."""
    best = counts.select("t", value.alias("v")).where("v > 0").agg(F.max(F.struct("v", (-F.col("t")).alias("t"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"), F.coalesce("b.v", F.lit(0.0)).alias("value"))


@query(f"WITH {SCORED}, {_grid(GRID50)}, {CONF}, m AS (SELECT t, CASE WHEN tp+fp+fn = 0 THEN 0.0 ELSE tp/(tp+fp+fn) END AS v FROM c), {BEST.format(name='b')} SELECT t AS threshold, round(v, 6) AS iou FROM b")
def best_iou_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold of 50 from 0.01 to 0.99 with the largest IoU, the lowest of equals; 0.5 if all are 0."""
    iou = M.ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))
    return _best(M.threshold_counts(scored(spark, sf), GRID50), iou).select("threshold", rounded(F.col("value"), 6).alias("iou"))


@query(f"""WITH {SCORED}, {_grid(GRID100)}, {CONF}, f AS (WITH m AS (SELECT t, {PRF[2]} AS v FROM c), {BEST.format(name='b')} SELECT 'f1' AS metric, t, v FROM b),
i AS (WITH m AS (SELECT t, tp/(tp+fp+fn+1e-8) AS v FROM c), {BEST.format(name='b')} SELECT 'iou' AS metric, t, v FROM b)
SELECT metric, t AS threshold, round(v, 6) AS value FROM (SELECT * FROM f UNION ALL SELECT * FROM i)""")
def best_threshold_100(spark: SparkSession, sf: str) -> DataFrame:
    """The best of 100 thresholds from 0.1 to 0.9, by F1 and by IoU with 1e-8 in its denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counts = materialize(M.threshold_counts(scored(spark, sf), GRID100), "counts")
    parts = [_best(counts, v).select(F.lit(n).alias("metric"), "threshold", rounded(F.col("value"), 6).alias("value")) for n, v in (("f1", M.ratio(2 * tp, 2 * tp + fp + fn)), ("iou", tp / (tp + fp + fn + 1e-8)))]
    return parts[0].union(parts[1])


@query(f"WITH {SCORED}, {STEPS}, f AS (SELECT p, 2*tp/(tp+fp+(SELECT sum(pos) FROM v)) AS f1 FROM s) SELECT p AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, p LIMIT 1")
def pr_optimal_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The score with the largest F1, the lowest of equals."""
    steps = materialize(M.score_steps(scored(spark, sf)), "steps")
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(_positives(steps)))
    return steps.agg(F.max(F.struct(f1.alias("f1"), (-F.col("p")).alias("p"))).alias("b")).select((-F.col("b.p")).alias("threshold"), rounded(F.col("b.f1"), 6).alias("f1"))


@query(f"WITH {SCORED} SELECT protein_key, round(quantile_cont(p, 0.95), 6) AS p95, round(quantile_cont(p, 0.97), 6) AS p97 FROM scored GROUP BY protein_key")
def percentile_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Per protein, linear percentiles."""
    told = M.quantiles(scored(spark, sf), ["protein_key"], "p", {"p95": 0.95, "p97": 0.97})
    return told.select("protein_key", rounded(F.col("p95"), 6).alias("p95"), rounded(F.col("p97"), 6).alias("p97"))


def kth_and_percentiles(rows: DataFrame, share: float, qs: dict[str, float]) -> DataFrame:
    """``protein_key, n, kth`` and quantiles of p: kth is the k-th highest, k = max(1, int(share n))."""
    n = rows.groupBy("protein_key").agg(F.count("*").alias("n"))
    wanted = n.select("protein_key", F.lit("kth").alias("name"), (F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * share))).cast("long").alias("at"))
    kth = M.order_statistics(rows, ["protein_key"], "p", wanted).select("protein_key", F.col("value").alias("kth"))
    return kth.join(M.quantiles(rows, ["protein_key"], "p", qs) if qs else n, "protein_key")


@query(f"""WITH {SCORED}, r AS (SELECT protein_key, p, row_number() OVER (PARTITION BY protein_key ORDER BY p DESC) AS r, count(*) OVER (PARTITION BY protein_key) AS n FROM scored)
SELECT protein_key, n, p AS threshold FROM r WHERE r = greatest(1, CAST(floor(n * 0.03) AS BIGINT))""")
def prevalence_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Per protein, the k-th highest probability, k = max(1, int(0.03 n))."""
    return kth_and_percentiles(scored(spark, sf), 0.03, {}).select("protein_key", "n", F.col("kth").alias("threshold"))


@query(f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE y = 1) AS positives, round(count(*) FILTER (WHERE y <> 1)/greatest(1, count(*) FILTER (WHERE y = 1)), 6) AS pos_weight, round(ln(avg(y)/greatest(1e-6, 1-avg(y))), 6) AS bias FROM scored")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, the weight of positives and the bias that gives their share."""
    pos, neg = F.count(F.when(F.col("y") == 1, 1)), F.count(F.when(F.col("y") != 1, 1))
    share = F.avg("y")
    return scored(spark, sf).agg(F.count("*").alias("n"), pos.alias("positives"), rounded(neg / F.greatest(F.lit(1), pos), 6).alias("pos_weight"), rounded(F.ln(share / F.greatest(F.lit(1e-6), 1 - share)), 6).alias("bias"))


@query(f"""WITH {SCORED}, c AS (SELECT y, greatest(1e-7, least(1-1e-7, p)) AS q FROM scored) SELECT
  round(avg(CASE WHEN y = 1 THEN -0.25*power(1-q, 2)*ln(q) ELSE -0.75*power(q, 2)*ln(1-q) END), 6) AS focal,
  round(avg(CASE WHEN y = 1 THEN -ln(q)*(1-q) ELSE -ln(greatest(least(1-q+0.05, 1.0), 1e-7))*power(1-least(1-q+0.05, 1.0), 4) END), 6) AS asymmetric,
  round(avg(CASE WHEN y = 1 THEN -5*ln(q) ELSE -ln(1-q) END), 6) AS weighted_bce FROM c""")
def loss_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean focal, asymmetric and weighted cross-entropy losses."""
    p, y = F.col("p"), F.col("y")
    return scored(spark, sf).agg(rounded(F.avg(X.focal_loss(p, y)), 6).alias("focal"), rounded(F.avg(X.asymmetric_loss(p, y)), 6).alias("asymmetric"), rounded(F.avg(X.weighted_bce(p, y, 5.0)), 6).alias("weighted_bce"))


@query(f"""WITH {SCORED}, {_grid([0.5])}, a AS (SELECT 'raw' AS kind, y, p FROM scored UNION ALL SELECT 'calibrated', y, 1/(1+exp(-(8*least(1, greatest(0, p))-4))) FROM scored),
m AS (SELECT kind, round(avg((p-y)*(p-y)), 6) AS brier, round(avg(p), 6) AS mean_p FROM a GROUP BY kind),
l AS (SELECT kind, 'brier' AS metric, brier AS v FROM m UNION ALL SELECT kind, 'mean_p', mean_p FROM m)
SELECT r.metric, r.v AS before, c.v AS after, round(c.v - r.v, 6) AS delta, CASE WHEN r.v > 0 THEN round((c.v - r.v)/r.v*100, 4) END AS percent FROM l r JOIN l c ON r.metric = c.metric WHERE r.kind = 'raw' AND c.kind = 'calibrated'""")
def before_after_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics before and after calibration with their change; percent only where the first is positive."""
    rows = scored(spark, sf).withColumn("c", X.platt(F.col("p"), 8.0, -4.0))
    err = lambda v: (F.col(v) - F.col("y")) * (F.col(v) - F.col("y"))
    one = rows.agg(*[rounded(F.avg(x), 6).alias(n) for n, x in (("b0", err("p")), ("m0", F.col("p")), ("b1", err("c")), ("m1", F.col("c")))])
    long = one.select(F.expr("stack(2, 'brier', b0, b1, 'mean_p', m0, m1) AS (metric, before, after)"))
    change = F.col("after") - F.col("before")
    return long.select("metric", "before", "after", rounded(change, 6).alias("delta"), F.when(F.col("before") > 0, rounded(change / F.col("before") * 100, 4)).alias("percent"))


@query(f"WITH {SCORED} SELECT point_id, round(1/(1+exp(-(8*least(1, greatest(0, p))-4))), 6) AS calibrated FROM scored")
def platt_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities through sigmoid(a p + b)."""
    return scored(spark, sf).select("point_id", rounded(X.platt(F.col("p"), 8.0, -4.0), 6).alias("calibrated"))


@query(f"WITH {PKT}, m AS (SELECT avg(score) AS mu, stddev_pop(score) AS sd FROM pkt) SELECT pocket_id, round(CASE WHEN sd > 0 THEN (score-mu)/sd ELSE 0 END, 5) AS z FROM pkt CROSS JOIN m")
def zscore_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Pocket scores as z-scores."""
    rows = ranked(spark, sf)
    one = rows.agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd")).first()
    return rows.select("pocket_id", rounded(X.z_score(F.col("score"), F.lit(one["mu"]), F.lit(one["sd"])), 5).alias("z"))


TP, FP = [0.0, 4.0, 10.0, 18.0, 28.0, 40.0], [5.0, 40.0, 70.0, 90.0, 100.0, 104.0]


@query(f"""WITH {PKT}, k AS (SELECT pocket_id, score/5.0 AS pos, least(greatest(CAST(floor(score/5.0) AS INT), 0), 5) AS k FROM pkt),
v AS (SELECT pocket_id, k, least(greatest(pos-k, 0.0), 1.0) AS s, {TP}[k+1] AS t0, {TP}[least(k+2, 6)] AS t1, {FP}[k+1] AS f0, {FP}[least(k+2, 6)] AS f1 FROM k),
w AS (SELECT pocket_id, CASE WHEN k < 5 THEN t0+(t1-t0)*s ELSE t0 END AS t, CASE WHEN k < 5 THEN f0+(f1-f0)*s ELSE f0 END AS f FROM v)
SELECT pocket_id, round(CASE WHEN t+f > 0 THEN t/(t+f) ELSE 0 END, 6) AS probability FROM w""")
def hist_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Pocket scores as probabilities of cumulative histograms."""
    return ranked(spark, sf).select("pocket_id", rounded(X.histogram_probability(F.col("score"), 0.0, 30.0, TP, FP), 6).alias("probability"))


@query()
def platt_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Platt's a and b by Newton steps on counts of equal scores; every step is one aggregate over the table. Iterative, so no SQL."""
    counts = materialize(scored(spark, sf).groupBy("p", "y").count(), "counts")
    a, b, l2, steps = 0.0, 0.0, 1e-4, 0
    for steps in range(1, 31):
        q = X.sigmoid(F.col("p") * a + b)
        err, w = (q - F.col("y")) * F.col("count"), q * (1 - q) * F.col("count")
        r = counts.agg(*[F.sum(v).alias(n) for n, v in (("ga", err * F.col("p")), ("gb", err), ("haa", w * F.col("p") * F.col("p")), ("hab", w * F.col("p")), ("hbb", w))]).first()
        if r["gb"] is None:
            break
        ga, gb, haa, hbb = r["ga"] + l2 * a, r["gb"] + l2 * b, r["haa"] + l2, r["hbb"] + l2
        det = haa * hbb - r["hab"] ** 2
        da, db = (hbb * ga - r["hab"] * gb) / det, (haa * gb - r["hab"] * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return spark.createDataFrame([(a, b, steps)], "a double, b double, steps int")


@query()
def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Isotonic calibration: its boundaries and values. Iterative, so no SQL."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = scored(spark, sf).groupBy("p").agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(weightCol="weight").fit(VectorAssembler(inputCols=["p"], outputCol="features").transform(rows))
    pairs = zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist())
    return spark.createDataFrame([(float(x), min(1.0, max(0.0, float(v)))) for x, v in pairs], "boundary double, value double")


@query(f"WITH {SCORED} SELECT protein_key, count(*) AS n, round(avg(p), 6) AS mean_p, round(stddev_pop(p), 6) AS std_p, max(p) AS max_p, round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM scored GROUP BY protein_key")
def prediction_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Per protein, the distribution of its probabilities."""
    return scored(spark, sf).groupBy("protein_key").agg(F.count("*").alias("n"), rounded(F.avg("p"), 6).alias("mean_p"), rounded(F.stddev_pop("p"), 6).alias("std_p"), F.max("p").alias("max_p"), rounded(F.avg((F.col("p") >= 0.5).cast("double")), 6).alias("positive_rate"))
