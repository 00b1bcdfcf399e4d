"""Pockets: clusters of strong points, their ranking, and how they compare with the labelled sites."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelmill.functions.expressions import distance2, rounded
from voxelmill.operators import graph, metrics as M, spatial
from voxelmill.plans.registry import CLUSTERS, PTS, RES, points, query, residues
from voxelmill.plans.spatial import D2, _graph_neighbours
from voxelmill.storage import materialize

GROW = f"""grown AS (SELECT DISTINCT a.protein_key, a.cluster_id, b.point_id, b.prob, b.residue_number FROM core a JOIN pts b ON a.protein_key = b.protein_key AND {D2} <= 3.5*3.5)"""
AGG = """pocket AS (
  SELECT g.protein_key, g.cluster_id, g.score, g.sum_prob, c.sample_points, g.members, g.surface_atoms, c.cx, c.cy, c.cz FROM
  (SELECT protein_key, cluster_id, round(sum(prob*prob), 6) AS score, round(sum(prob), 6) AS sum_prob, count(*) AS members, count(DISTINCT residue_number) AS surface_atoms FROM grown GROUP BY ALL) g
  JOIN (SELECT protein_key, cluster_id, count(*) AS sample_points, round(avg(x), 5) AS cx, round(avg(y), 5) AS cy, round(avg(z), 5) AS cz FROM core GROUP BY ALL) c USING (protein_key, cluster_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY protein_key ORDER BY score DESC, cluster_id) AS INT) AS rank FROM pocket)"""
BASE = f"WITH RECURSIVE {PTS}, " + CLUSTERS.format(least=0.88, radius=3.0, size=3) + f", {GROW}, {AGG}"
TRUTH = f"""gpts AS (SELECT * FROM pts WHERE label >= 0.5),
glinks AS (SELECT a.point_id AS a, b.point_id AS b FROM gpts a JOIN gpts b ON a.protein_key = b.protein_key AND {D2} <= 9.0),
gwalk AS (SELECT point_id AS id, point_id AS reach FROM gpts UNION SELECT gwalk.id, glinks.b FROM gwalk JOIN glinks ON gwalk.reach = glinks.a),
gnamed AS (SELECT id, min(reach) AS site_id, count(*) AS n FROM gwalk GROUP BY id),
site AS (SELECT protein_key, point_id, site_id, x, y, z FROM gnamed JOIN gpts ON id = point_id WHERE n >= 3)"""
BOTH = f"{BASE}, {TRUTH}"
CROSS = """ps AS (SELECT protein_key, cluster_id, count(*) AS np FROM grown GROUP BY ALL),
gs AS (SELECT protein_key, site_id, count(*) AS ng, round(avg(x), 5) AS gx, round(avg(y), 5) AS gy, round(avg(z), 5) AS gz FROM site GROUP BY ALL),
shared AS (SELECT grown.protein_key, cluster_id, site_id, count(*) AS overlap FROM grown JOIN site ON grown.protein_key = site.protein_key AND grown.point_id = site.point_id GROUP BY ALL),
cmp AS (SELECT ps.protein_key, ps.cluster_id, gs.site_id, coalesce(overlap, 0) AS overlap, round(coalesce(overlap, 0) / (np + ng - coalesce(overlap, 0)), 6) AS iou,
    round(sqrt((cx-gx)*(cx-gx) + (cy-gy)*(cy-gy) + (cz-gz)*(cz-gz)), 4) AS distance, rank, score
  FROM ps JOIN gs ON ps.protein_key = gs.protein_key JOIN ranked ON ranked.cluster_id = ps.cluster_id AND ranked.protein_key = ps.protein_key LEFT JOIN shared ON shared.cluster_id = ps.cluster_id AND shared.site_id = gs.site_id)"""
FULL = f"{BOTH}, {CROSS}"


def clusters(pts: DataFrame, least: float = 0.88, radius: float = 3.0, size: int = 3) -> DataFrame:
    """``protein_key, point_id, cluster_id`` with the points' columns."""
    core = graph.density_clusters(pts.where(F.col("prob") >= least), "protein_key", "point_id", radius, 1, size)
    return core.join(pts.drop("protein_key"), "point_id")


class Pockets(NamedTuple):
    """Points, cores of clusters, ranked pockets and their grown members (``protein_key, cluster_id, point_id``)."""

    points: DataFrame
    core: DataFrame
    ranked: DataFrame
    grown: DataFrame


def aggregate(core: DataFrame, grown: DataFrame, pts: DataFrame, power: float = 2.0) -> DataFrame:
    """Pocket scores over grown members, sample points and centres over the core; ranked inside each protein."""
    keys = ["protein_key", "cluster_id"]
    members = grown.join(pts.select("point_id", "prob", "residue_number"), "point_id")
    score = rounded(F.sum(F.pow("prob", F.lit(power)) if power != 2 else F.col("prob") * F.col("prob")), 6)
    sums = members.groupBy(*keys).agg(score.alias("score"), rounded(F.sum("prob"), 6).alias("sum_prob"), F.count("*").alias("members"), F.countDistinct("residue_number").alias("surface_atoms"))
    centre = core.groupBy(*keys).agg(F.count("*").alias("sample_points"), *[rounded(F.avg(a), 5).alias(f"c{a}") for a in spatial.AXES])
    return graph.place(sums.join(centre, keys), "protein_key", F.desc("score"), "cluster_id")


def pockets(spark: SparkSession, sf: str, keep: bool = False) -> Pockets:
    """Points and cores are written, as several joins read them; with ``keep`` pockets and members too."""
    pts = materialize(points(spark, sf), "points")
    core = materialize(clusters(pts), "core")
    grown = spatial.grow(core, pts, "protein_key", "cluster_id", "point_id", 3.5)
    grown = materialize(grown, "grown") if keep else grown
    ranked = aggregate(core, grown, pts)
    return Pockets(pts, core, materialize(ranked, "ranked") if keep else ranked, grown)


COLS = "protein_key, cluster_id, score, sum_prob, sample_points, members, surface_atoms, cx, cy, cz, rank"


@query(f"{BASE} SELECT {COLS} FROM ranked")
def pockets_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold, single linkage, growth, scoring and ranking."""
    return pockets(spark, sf).ranked.select(*COLS.split(", "))


@query(f"{BASE} SELECT protein_key, cluster_id, point_id FROM grown")
def cluster_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each pocket: all points within 3.5 A of its core."""
    return pockets(spark, sf).grown


@query(f"WITH RECURSIVE {PTS}, {TRUTH} SELECT protein_key, site_id, point_id FROM site")
def gt_pockets(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of positive points: the same clustering on labels, without growth."""
    return _sites(points(spark, sf)).select("protein_key", "site_id", "point_id")


def _sites(pts: DataFrame) -> DataFrame:
    site = graph.density_clusters(pts.where("label >= 0.5"), "protein_key", "point_id", 3.0, 1, 3)
    return site.withColumnRenamed("cluster_id", "site_id").join(pts.select("point_id", "x", "y", "z"), "point_id")


class Truth(NamedTuple):
    """Pockets, sites (``ng`` points, centre ``gx, gy, gz``), site points, and the pairs of pockets and sites that are looked at."""

    made: Pockets
    sites: DataFrame
    site: DataFrame
    pairs: DataFrame


def _centres(site: DataFrame) -> DataFrame:
    return site.groupBy("protein_key", "site_id").agg(F.count("*").alias("ng"), *[rounded(F.avg(a), 5).alias(f"g{a}") for a in spatial.AXES])


def _described(pairs: DataFrame, ranked: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds IoU, centre distance, rank and score to ``protein_key, cluster_id, site_id, overlap``."""
    rows = pairs.join(ranked, ["protein_key", "cluster_id"]).join(sites, ["protein_key", "site_id"])
    gap = F.sqrt(distance2([F.col(f"c{a}") for a in "xyz"], [F.col(f"g{a}") for a in "xyz"]))
    iou = F.col("overlap") / (F.col("members") + F.col("ng") - F.col("overlap"))
    return rows.select("protein_key", "cluster_id", "site_id", "overlap", rounded(iou, 6).alias("iou"), rounded(gap, 4).alias("distance"), "rank", "score")


def _shared(grown: DataFrame, site: DataFrame) -> DataFrame:
    return grown.join(site.select("protein_key", "point_id", "site_id"), ["protein_key", "point_id"]).groupBy("protein_key", "cluster_id", "site_id").agg(F.count("*").alias("overlap"))


def compared(spark: SparkSession, sf: str, near: float = 6.0) -> Truth:
    """Pockets, sites and the pairs that overlap or whose centres lie within ``near``; only such pairs are formed.

    A little more than the radius is joined and the rounded distance decides,
    as it does where all pairs are told.
    """
    made = pockets(spark, sf, keep=True)
    site = materialize(_sites(made.points), "site")
    sites = materialize(_centres(site), "sites")
    keys = ["protein_key", "cluster_id", "site_id"]
    centre = lambda df, name, p: df.select("protein_key", name, *[F.col(f"{p}{a}").alias(a) for a in spatial.AXES])
    close = spatial.radius_join(centre(made.ranked, "cluster_id", "c"), centre(sites, "site_id", "g"), "protein_key", near + 0.001).select(*keys, F.lit(0).cast("long").alias("overlap"))
    valid = _shared(made.grown, site).unionByName(close).groupBy(*keys).agg(F.max("overlap").alias("overlap"))
    pairs = _described(valid, made.ranked, sites).where((F.col("overlap") >= 1) | (F.col("distance") <= near))
    return Truth(made, sites, site, materialize(pairs, "compared"))


def _both(truth: Truth) -> DataFrame:
    """Proteins with pockets and sites."""
    return truth.made.ranked.select("protein_key").distinct().join(truth.sites.select("protein_key").distinct(), "protein_key")


@query(f"{FULL} SELECT protein_key, cluster_id, site_id, overlap, iou, distance FROM cmp")
def pocket_site_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pocket with every site of its protein: the one query that tells all pairs."""
    made = pockets(spark, sf, keep=True)
    site = materialize(_sites(made.points), "site")
    sites = _centres(site)
    keys = ["protein_key", "cluster_id", "site_id"]
    every = made.ranked.select("protein_key", "cluster_id").join(sites.select("protein_key", "site_id"), "protein_key").join(_shared(made.grown, site), keys, "left").fillna(0, ["overlap"])
    return _described(every, made.ranked, sites).select(*keys, "overlap", "iou", "distance")


@query(f"{FULL}, best AS (SELECT protein_key, site_id, max(iou) AS b FROM cmp GROUP BY ALL) SELECT protein_key, round(avg(b), 6) AS mean_iou, max(b) AS best_iou, round(avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM best GROUP BY protein_key")
def pocket_iou_gt(spark: SparkSession, sf: str) -> DataFrame:
    """Per protein, over its sites: mean and largest of their best IoU, and how many are hit at all."""
    truth = compared(spark, sf)
    return _over_sites(truth).join(_both(truth), "protein_key", "left_semi")


def _over_sites(truth: Truth) -> DataFrame:
    """``protein_key, mean_iou, best_iou, coverage`` over the sites of every protein that has any; what no pocket meets counts 0."""
    best = truth.pairs.groupBy("protein_key", "site_id").agg(F.max("iou").alias("b"))
    every = truth.sites.select("protein_key", "site_id").join(best, ["protein_key", "site_id"], "left").fillna(0.0, ["b"])
    return every.groupBy("protein_key").agg(rounded(F.avg("b"), 6).alias("mean_iou"), F.max("b").alias("best_iou"), rounded(F.avg((F.col("b") > 0).cast("double")), 6).alias("coverage"))


@query(f"""{FULL}, p AS (SELECT protein_key, cluster_id, max(iou) AS b FROM cmp GROUP BY ALL), g AS (SELECT protein_key, site_id, max(iou) AS b FROM cmp GROUP BY ALL)
SELECT * FROM (SELECT protein_key, round(avg(b), 6) AS mean_iou, max(b) AS best_iou, round(avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM p GROUP BY protein_key) JOIN (SELECT protein_key, round(avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM g GROUP BY protein_key) USING (protein_key)""")
def pocket_iou_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Per protein, over its pockets: mean and largest of their best IoU; precision and recall by any overlap."""
    truth = compared(spark, sf)
    best = truth.pairs.groupBy("protein_key", "cluster_id").agg(F.max("iou").alias("b"))
    every = truth.made.ranked.select("protein_key", "cluster_id").join(best, ["protein_key", "cluster_id"], "left").fillna(0.0, ["b"])
    preds = every.groupBy("protein_key").agg(rounded(F.avg("b"), 6).alias("mean_iou"), F.max("b").alias("best_iou"), rounded(F.avg((F.col("b") > 0).cast("double")), 6).alias("precision"))
    return preds.join(_over_sites(truth).select("protein_key", F.col("coverage").alias("recall")), "protein_key")


@query(f"""{FULL}, k AS (SELECT unnest([1, 3, 5]) AS k), g AS (SELECT DISTINCT protein_key FROM gs),
h AS (SELECT g.protein_key, k.k, max(CASE WHEN cmp.rank <= k.k AND (overlap >= 1 OR distance <= 6) THEN 1 ELSE 0 END) AS hit FROM g CROSS JOIN k LEFT JOIN cmp USING (protein_key) GROUP BY ALL)
SELECT k, count(*) AS proteins, round(avg(hit), 6) AS hit_rate FROM h GROUP BY k""")
def hit_rate_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Share of proteins with sites of which one of the first k pockets overlaps a site or lies within 6 A of its centre."""
    truth = compared(spark, sf)
    valid = truth.pairs.groupBy("protein_key").agg(F.min("rank").alias("first"))
    rows = truth.sites.select("protein_key").distinct().join(valid, "protein_key", "left").withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    return rows.groupBy("k").agg(F.count("*").alias("proteins"), rounded(F.avg(F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))), 6).alias("hit_rate"))


@query(f"{FULL}, m AS (SELECT protein_key, site_id, min(distance) AS d FROM cmp GROUP BY ALL) SELECT protein_key, count(*) AS sites, round(avg(d), 4) AS mean_distance, round(quantile_cont(d, 0.5), 4) AS median_distance, min(d) AS least_distance FROM m GROUP BY protein_key")
def center_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Per protein, the distances of its sites' centres to the nearest pocket centre."""
    m = _nearest_pockets(pockets(spark, sf, keep=True))
    told = M.quantiles(m, ["protein_key"], "distance", {"median": 0.5})
    sums = m.groupBy("protein_key").agg(rounded(F.avg("distance"), 4).alias("mean_distance"), F.min("distance").alias("least_distance"))
    return sums.join(told, "protein_key").select("protein_key", F.col("n").alias("sites"), "mean_distance", rounded(F.col("median"), 4).alias("median_distance"), "least_distance")


def _nearest_pockets(made: Pockets) -> DataFrame:
    """``protein_key, site_id, cluster_id, distance, rank``: the pocket nearest to each site's centre, the first by rank of equals."""
    sites = materialize(_centres(_sites(made.points)).select("protein_key", "site_id", *[F.col(f"g{a}").alias(a) for a in spatial.AXES]), "sites")
    centres = made.ranked.select("protein_key", F.col("rank").alias("pocket"), *[F.col(f"c{a}").alias(a) for a in spatial.AXES])
    near = spatial.nearest_join(sites, centres, "protein_key", "site_id", "pocket", 12.0).withColumnRenamed("pocket", "rank")
    named = near.join(made.ranked.select("protein_key", "rank", "cluster_id"), ["protein_key", "rank"])
    return materialize(named.select("protein_key", "site_id", "cluster_id", rounded(F.sqrt("d2"), 4).alias("distance"), "rank"), "nearest")


@query(f"""{FULL}, k AS (SELECT unnest([1, 3]) AS k),
dca AS (SELECT c.protein_key, s.site_id, c.rank, round(sqrt(min((c.cx-s.x)*(c.cx-s.x) + (c.cy-s.y)*(c.cy-s.y) + (c.cz-s.z)*(c.cz-s.z))), 4) AS dca FROM ranked c JOIN site s ON c.protein_key = s.protein_key GROUP BY ALL),
both_d AS (SELECT gs.protein_key, gs.site_id, k.k, min(cmp.distance) FILTER (WHERE cmp.rank <= k.k) AS dcc, min(dca.dca) FILTER (WHERE dca.rank <= k.k) AS dca
  FROM gs CROSS JOIN k LEFT JOIN cmp ON cmp.protein_key = gs.protein_key AND cmp.site_id = gs.site_id LEFT JOIN dca ON dca.protein_key = gs.protein_key AND dca.site_id = gs.site_id AND dca.rank = cmp.rank GROUP BY ALL)
SELECT k, count(*) AS sites, round(avg(CASE WHEN dcc <= 4 THEN 1.0 ELSE 0.0 END), 6) AS dcc_success, round(avg(CASE WHEN dca <= 4 THEN 1.0 ELSE 0.0 END), 6) AS dca_success, round(avg(dcc), 3) AS mean_dcc, round(avg(dca), 3) AS mean_dca FROM both_d GROUP BY k""")
def dcc_dca_success(spark: SparkSession, sf: str) -> DataFrame:
    """Success at the first k pockets by distance to a site's centre (DCC) and to its nearest point (DCA); sites without pockets count as missed."""
    made = pockets(spark, sf, keep=True)
    member = materialize(_sites(made.points), "site")
    sites = _centres(member)
    # no pocket beyond the third counts, so a site point meets three centres at most
    top = made.ranked.where("rank <= 3").select("protein_key", "rank", "cx", "cy", "cz")
    gap = lambda p: distance2([F.col(f"c{a}") for a in "xyz"], [F.col(f"{p}{a}") for a in "xyz"])
    keys = ["protein_key", "site_id", "rank"]
    dca = member.join(top, "protein_key").groupBy(*keys).agg(rounded(F.sqrt(F.min(gap(""))), 4).alias("dca"))
    dcc = sites.join(top, "protein_key").select(*keys, rounded(F.sqrt(gap("g")), 4).alias("dcc"))
    all_sites = sites.select("protein_key", "site_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("k"))
    best = all_sites.join(dcc.join(dca, keys), ["protein_key", "site_id"], "left").groupBy("protein_key", "site_id", "k").agg(F.min(F.when(F.col("rank") <= F.col("k"), F.col("dcc"))).alias("dcc"), F.min(F.when(F.col("rank") <= F.col("k"), F.col("dca"))).alias("dca"))
    ok = lambda c: rounded(F.avg(F.coalesce((F.col(c) <= 4).cast("double"), F.lit(0.0))), 6)
    return best.groupBy("k").agg(F.count("*").alias("sites"), ok("dcc").alias("dcc_success"), ok("dca").alias("dca_success"), rounded(F.avg("dcc"), 3).alias("mean_dcc"), rounded(F.avg("dca"), 3).alias("mean_dca"))


#: Pairs in the order of the choice; a step takes the next one of every protein if both its ends are free.
GREEDY = f"""{FULL}, valid AS (SELECT *, row_number() OVER (PARTITION BY protein_key ORDER BY iou DESC, distance, cluster_id, site_id) AS r FROM cmp WHERE overlap >= 1 OR distance <= 6),
steps AS (SELECT protein_key, 0::BIGINT AS r, []::BIGINT[] AS ps, []::BIGINT[] AS ss, false AS taken FROM (SELECT DISTINCT protein_key FROM valid)
  UNION ALL SELECT v.protein_key, v.r, CASE WHEN ok THEN list_append(ps, v.cluster_id) ELSE ps END, CASE WHEN ok THEN list_append(ss, v.site_id) ELSE ss END, ok
  FROM (SELECT v.*, s.ps, s.ss, NOT list_contains(s.ps, v.cluster_id) AND NOT list_contains(s.ss, v.site_id) AS ok FROM steps s JOIN valid v ON v.protein_key = s.protein_key AND v.r = s.r + 1) v),
match AS (SELECT valid.* FROM valid JOIN steps ON steps.protein_key = valid.protein_key AND steps.r = valid.r AND taken)"""


def _matches(truth: Truth) -> DataFrame:
    """One-to-one matches, by IoU from high to low, then by distance."""
    return graph.greedy_match(truth.pairs, "cluster_id", "site_id", [-F.col("iou"), F.col("distance")])


@query(f"{GREEDY} SELECT protein_key, cluster_id, site_id, overlap, iou, distance FROM match")
def greedy_matches(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one matches of pockets and sites, by IoU from high to low, among pairs that overlap or lie within 6 A."""
    return _matches(compared(spark, sf)).select("protein_key", "cluster_id", "site_id", "overlap", "iou", "distance")


MATCHED = f"""{GREEDY}, m AS (SELECT protein_key, count(*) AS tp, avg(iou) AS mi, avg(distance) AS md FROM match GROUP BY protein_key), a AS (SELECT protein_key, count(*) AS pockets FROM ranked GROUP BY protein_key), b AS (SELECT protein_key, count(*) AS sites FROM gs GROUP BY protein_key),
j AS (SELECT coalesce(a.protein_key, b.protein_key) AS protein_key, coalesce(pockets, 0) AS pockets, coalesce(sites, 0) AS sites FROM a FULL JOIN b ON a.protein_key = b.protein_key),
per AS (SELECT j.*, coalesce(tp, 0) AS tp, coalesce(tp, 0)/(pockets+1e-8) AS p, coalesce(tp, 0)/(sites+1e-8) AS r, coalesce(mi, 0) AS mi, md FROM j LEFT JOIN m ON j.protein_key = m.protein_key)"""


@query(f"{MATCHED} SELECT protein_key, pockets, sites, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(2*p*r/(p+r+1e-8), 6) AS f1, round(mi, 6) AS mean_iou, coalesce(round(md, 4), CAST('inf' AS DOUBLE)) AS mean_distance FROM per")
def match_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per protein: precision, recall and F1 of the matches, mean IoU and mean distance (infinite without matches)."""
    truth = compared(spark, sf)
    m = _matches(truth).groupBy("protein_key").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"), F.avg("distance").alias("mean_distance"))
    rows = truth.made.ranked.groupBy("protein_key").agg(F.count("*").alias("pockets")).join(truth.sites.groupBy("protein_key").agg(F.count("*").alias("sites")), "protein_key", "full").join(m, "protein_key", "left").fillna(0, ["tp", "pockets", "sites"])
    p, r = F.col("tp") / (F.col("pockets") + 1e-8), F.col("tp") / (F.col("sites") + 1e-8)
    return rows.select("protein_key", "pockets", "sites", "tp", rounded(p, 6).alias("precision"), rounded(r, 6).alias("recall"), rounded(2 * p * r / (p + r + 1e-8), 6).alias("f1"), rounded(F.coalesce("mean_iou", F.lit(0.0)), 6).alias("mean_iou"), F.coalesce(rounded(F.col("mean_distance"), 4), F.lit(float("inf"))).alias("mean_distance"))


@query(f"""{GREEDY}, d AS (SELECT min(cmp.distance) AS d FROM cmp GROUP BY protein_key, site_id)
SELECT (SELECT count(*) FROM match) AS matches, (SELECT round(avg(distance), 4) FROM match) AS mean_matched, (SELECT round(quantile_cont(distance, 0.5), 4) FROM match) AS median_matched, round(avg(d), 4) AS mean_least, round(quantile_cont(d, 0.5), 4) AS median_least FROM d""")
def matched_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Centre distances over all proteins: of the matches, and of each site to its nearest pocket."""
    truth = compared(spark, sf)
    told = lambda rows, n: M.quantiles(rows, [], "distance", {"q": 0.5}).select(F.col("n").alias(f"n_{n}"), rounded(F.col("q"), 4).alias(f"median_{n}"), F.lit(1).alias("k")).join(rows.agg(rounded(F.avg("distance"), 4).alias(f"mean_{n}"), F.lit(1).alias("k")), "k")
    both = told(materialize(_matches(truth), "match"), "matched").join(told(_nearest_pockets(truth.made), "least"), "k")
    return both.select(F.col("n_matched").alias("matches"), "mean_matched", "median_matched", "mean_least", "median_least")


@query(f"""{BOTH}, t AS (SELECT unnest([0.5, 0.7, 0.88, 0.95]) AS t),
m AS (SELECT protein_key, t, count(*) FILTER (WHERE prob >= t AND coalesce(label, 0) = 1) AS i, count(*) FILTER (WHERE prob >= t OR coalesce(label, 0) = 1) AS u FROM pts CROSS JOIN t GROUP BY ALL),
v AS (SELECT *, CASE WHEN u = 0 THEN 1.0 ELSE i / u END AS iou FROM m)
SELECT CAST(t AS DOUBLE) AS threshold, round(avg(iou), 6) AS mean_iou, round(stddev_pop(iou), 6) AS std_iou, round(CASE WHEN sum(u) = 0 THEN 1.0 ELSE sum(i) / sum(u) END, 6) AS overall_iou FROM v GROUP BY t""")
def protein_iou_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """IoU of predicted and labelled points, per protein (1 where both are empty) and over all."""
    pts = points(spark, sf).select("protein_key", "prob", F.coalesce("label", F.lit(0)).alias("y")).withColumn("t", F.explode(F.array(*[F.lit(v) for v in (0.5, 0.7, 0.88, 0.95)])))
    on = F.col("prob") >= F.col("t")
    m = pts.groupBy("protein_key", "t").agg(F.count(F.when(on & (F.col("y") == 1), 1)).alias("i"), F.count(F.when(on | (F.col("y") == 1), 1)).alias("u"))
    v = m.withColumn("iou", F.when(F.col("u") == 0, 1.0).otherwise(F.col("i") / F.col("u")))
    return v.groupBy(F.col("t").alias("threshold")).agg(rounded(F.avg("iou"), 6).alias("mean_iou"), rounded(F.stddev_pop("iou"), 6).alias("std_iou"), rounded(F.when(F.sum("u") == 0, 1.0).otherwise(F.sum("i") / F.sum("u")), 6).alias("overall_iou"))


DBSCAN = f"""WITH RECURSIVE {PTS}, strong AS (SELECT * FROM pts WHERE prob >= 0.88),
links AS (SELECT a.point_id AS a, b.point_id AS b FROM strong a JOIN strong b ON a.protein_key = b.protein_key AND {D2} <= 9.0),
corep AS (SELECT a FROM links GROUP BY a HAVING count(*) >= 5),
inner_links AS (SELECT links.a, links.b FROM links JOIN corep c ON links.a = c.a JOIN corep d ON links.b = d.a),
walk AS (SELECT a AS id, a AS reach FROM corep UNION SELECT walk.id, inner_links.b FROM walk JOIN inner_links ON walk.reach = inner_links.a),
named AS (SELECT id, min(reach) AS cluster_id FROM walk GROUP BY id),
every AS (SELECT id AS point_id, cluster_id FROM named UNION ALL
  SELECT links.b, min(cluster_id) FROM links JOIN named ON links.a = named.id WHERE links.b NOT IN (SELECT id FROM named) GROUP BY links.b)
SELECT protein_key, point_id, cluster_id FROM every JOIN strong USING (point_id)"""


@query(DBSCAN)
def dbscan_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """DBSCAN of strong points: eps 3, five samples, noise left out."""
    return graph.density_clusters(points(spark, sf).where("prob >= 0.88"), "protein_key", "point_id", 3.0, 5).select("protein_key", "point_id", "cluster_id")


RESIDUE_SQL = f"""WITH RECURSIVE {RES},
near AS (SELECT a.residue_uid AS a, b.residue_uid AS b, {D2} AS d2, row_number() OVER (PARTITION BY a.residue_uid ORDER BY {D2}, b.residue_uid) AS rank FROM res a JOIN res b ON a.protein_key = b.protein_key),
one AS (SELECT a, b FROM near WHERE rank <= 16 AND d2 <= 64.0 AND a <> b), both_e AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
pos AS (SELECT * FROM res WHERE prob >= 0.3 AND rsa >= 0.2),
e AS (SELECT both_e.a, both_e.b FROM both_e JOIN pos p ON both_e.a = p.residue_uid JOIN pos q ON both_e.b = q.residue_uid),
walk AS (SELECT residue_uid AS id, residue_uid AS reach FROM pos UNION SELECT walk.id, e.b FROM walk JOIN e ON walk.reach = e.a),
named AS (SELECT id, min(reach) AS cluster_id FROM walk GROUP BY id)
SELECT protein_key, cluster_id, count(*) AS size, round(sum(prob), 6) AS sum_prob, round(sum(prob*x)/(sum(prob)+1e-8), 4) AS cx, round(sum(prob*y)/(sum(prob)+1e-8), 4) AS cy, round(sum(prob*z)/(sum(prob)+1e-8), 4) AS cz,
  round(avg(CASE WHEN rsa >= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS surface, round(sum(prob) * avg(CASE WHEN rsa >= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS score
FROM named JOIN pos ON id = residue_uid GROUP BY protein_key, cluster_id HAVING count(*) >= 5 AND sum(prob) >= 2 AND sum(prob) * avg(CASE WHEN rsa >= 0.2 THEN 1.0 ELSE 0.0 END) >= 0.1"""


@query(RESIDUE_SQL)
def residue_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of exposed probable residues in the residue graph, as weighted pockets of at least five residues, a probability sum of 2 and a score of 0.1."""
    rows = materialize(residues(spark, sf), "residues")
    pos = rows.where("prob >= 0.3 AND rsa >= 0.2")
    edges = graph.knn_graph(_graph_neighbours(spark, sf), "protein_key", "residue_uid", "other", 8.0)
    ids = pos.select("residue_uid")
    inner = edges.join(ids.withColumnRenamed("residue_uid", "a"), "a", "left_semi").join(ids.withColumnRenamed("residue_uid", "b"), "b", "left_semi")
    label = graph.group_components(inner, "protein_key")
    named = pos.join(label, pos["residue_uid"] == label["id"], "left").withColumn("cluster_id", F.coalesce("component", "residue_uid"))
    total = F.sum("prob")
    surface = F.avg((F.col("rsa") >= 0.2).cast("double"))
    out = named.groupBy("protein_key", "cluster_id").agg(F.count("*").alias("size"), total.alias("t"), *[rounded(F.sum(F.col("prob") * F.col(a)) / (total + 1e-8), 4).alias(f"c{a}") for a in spatial.AXES], rounded(surface, 6).alias("surface"), rounded(total * surface, 6).alias("score"))
    return out.where("size >= 5 AND t >= 2 AND score >= 0.1").select("protein_key", "cluster_id", "size", rounded(F.col("t"), 6).alias("sum_prob"), "cx", "cy", "cz", "surface", "score")


def _suppressed(kept_near: str) -> str:
    """SQL of suppression by rank: a step takes the next pocket of every protein unless a kept centre is near."""
    return f"""{BASE}, steps AS (SELECT protein_key, 0::BIGINT AS r, []::STRUCT(x DOUBLE, y DOUBLE, z DOUBLE)[] AS kept, false AS ok, NULL::BIGINT AS cluster_id FROM (SELECT DISTINCT protein_key FROM ranked)
  UNION ALL SELECT protein_key, rank, CASE WHEN free THEN list_append(kept, {{'x': cx, 'y': cy, 'z': cz}}) ELSE kept END, free, cluster_id
  FROM (SELECT p.*, s.kept, len(list_filter(s.kept, lambda k: (k.x-p.cx)*(k.x-p.cx) + (k.y-p.cy)*(k.y-p.cy) + (k.z-p.cz)*(k.z-p.cz) {kept_near} 36.0)) = 0 AS free FROM steps s JOIN ranked p ON p.protein_key = s.protein_key AND p.rank = s.r + 1))
SELECT protein_key, cluster_id FROM steps WHERE ok"""


def _nms(spark: SparkSession, sf: str, near: str) -> DataFrame:
    ranked = materialize(pockets(spark, sf).ranked, "ranked")
    centres = ranked.select("protein_key", "cluster_id", *[F.col(f"c{a}").alias(a) for a in spatial.AXES])
    pairs = spatial.radius_pairs(centres, "protein_key", "cluster_id", 6.0).where(near).select("a", "b")
    kept = graph.greedy_suppression(ranked, "cluster_id", [F.col("rank")], materialize(pairs, "near"))
    return ranked.join(kept, "cluster_id", "left_semi").select("protein_key", "cluster_id")


@query(_suppressed("<"))
def nms_pockets(spark: SparkSession, sf: str) -> DataFrame:
    """Pockets kept by greedy suppression of centres less than 6 A apart, by rank."""
    return _nms(spark, sf, "d2 < 36")


@query(_suppressed("<="))
def nms_pockets_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    """The same, 6 A itself being near."""
    return _nms(spark, sf, "d2 <= 36")


@query()
def nms_points(spark: SparkSession, sf: str) -> DataFrame:
    """Strong points kept by greedy suppression within 6 A (exclusive), by probability, then id; no SQL, as the choice is sequential over all strong points."""
    strong = materialize(points(spark, sf).where("prob >= 0.88").select("protein_key", "point_id", "prob", "x", "y", "z"), "strong")
    near = materialize(spatial.radius_pairs(strong, "protein_key", "point_id", 6.0).where("d2 < 36").select("a", "b"), "near")
    return graph.greedy_suppression(strong, "point_id", [-F.col("prob")], near)


@query(f"""{BASE}, passed AS (SELECT *, CAST(count(*) OVER (PARTITION BY protein_key) AS INT) AS n_pockets, row_number() OVER (PARTITION BY protein_key ORDER BY rank) AS place FROM ranked WHERE sum_prob >= 5 AND sample_points >= 6)
SELECT protein_key, cluster_id, score, rank, n_pockets FROM passed WHERE place <= 3""")
def pocket_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Pockets past the filters, three a protein; ranks keep their gaps, n_pockets counts what passed."""
    passed = pockets(spark, sf).ranked.where("sum_prob >= 5 AND sample_points >= 6")
    w = Window.partitionBy("protein_key")
    passed = passed.withColumn("n_pockets", F.count("*").over(w).cast("int")).withColumn("place", F.row_number().over(w.orderBy("rank")))
    return passed.where("place <= 3").select("protein_key", "cluster_id", "score", "rank", "n_pockets")


@query(f"""{BASE}, top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY prob DESC, point_id) AS r FROM grown) SELECT cluster_id, round(sum(prob*prob), 6) AS score FROM top WHERE r <= 5 GROUP BY cluster_id""")
def score_point_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Pocket scores from the five strongest members only."""
    made = pockets(spark, sf)
    grown = made.grown.join(made.points.select("point_id", "prob"), "point_id")
    top = graph.place(grown, "cluster_id", F.desc("prob"), "point_id").where("rank <= 5")
    return top.groupBy("cluster_id").agg(rounded(F.sum(F.col("prob") * F.col("prob")), 6).alias("score"))


@query(f"""{BASE}, g AS (SELECT DISTINCT protein_key, point_id FROM grown), m AS (SELECT pts.* FROM pts JOIN g ON pts.protein_key = g.protein_key AND pts.point_id = g.point_id),
d AS (SELECT a.point_id, count(*) AS near FROM m a JOIN pts b ON a.protein_key = b.protein_key AND {D2} <= 4.0 GROUP BY a.point_id)
SELECT m.point_id, near, round(prob*prob / near, 6) AS balanced FROM m JOIN d ON m.point_id = d.point_id""")
def density_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Squared probability of every member of a pocket over the number of the protein's points within 2 A, itself counted."""
    made = pockets(spark, sf)
    pts = made.points.select("protein_key", "point_id", "prob", "x", "y", "z")
    members = pts.join(made.grown.select("protein_key", "point_id").distinct(), ["protein_key", "point_id"], "left_semi")
    near = spatial.radius_join(members, pts.select("protein_key", F.col("point_id").alias("other"), "x", "y", "z"), "protein_key", 2.0)
    return near.groupBy("point_id", "prob").agg(F.count("*").alias("near")).select("point_id", "near", rounded(F.col("prob") * F.col("prob") / F.col("near"), 6).alias("balanced"))


@query()
def hull_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Convex-hull volume of each pocket's grown members; no SQL."""
    made = pockets(spark, sf)
    grown = made.grown.join(made.points.select("point_id", *spatial.AXES), "point_id")
    return graph.hull_volumes(grown, "protein_key", "cluster_id").withColumn("volume", rounded(F.col("volume"), 4))


def _sweep(spark: SparkSession, sf: str, configs: list[tuple[float, float, int]]) -> DataFrame:
    """``protein_key, threshold, radius, least, cluster_id, n, score`` of all settings in one pass: the setting is part of the group."""
    pts = materialize(points(spark, sf).where(F.col("prob") >= min(c[0] for c in configs)).select("protein_key", "point_id", "x", "y", "z", "prob"), "sweep")
    parts = None
    for radius in sorted({c[1] for c in configs}):
        ts = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, r, m in configs if r == radius]))
        rows = pts.withColumn("c", ts).where("prob >= c.t").select(F.concat_ws("|", "protein_key", F.col("c.t").cast("string"), F.col("c.m").cast("string")).alias("g"), "protein_key", F.col("c.t").alias("threshold"), F.col("c.m").alias("least"), "point_id", "x", "y", "z", "prob")
        c = graph.density_clusters(rows, "g", "point_id", radius).join(rows.select("g", "point_id", "protein_key", "threshold", "least", "prob"), ["g", "point_id"])
        part = c.groupBy("protein_key", "threshold", "least", "cluster_id").agg(F.count("*").alias("n"), rounded(F.sum(F.col("prob") * F.col("prob")), 6).alias("score")).withColumn("radius", F.lit(radius))
        parts = part if parts is None else parts.unionByName(part)
    return parts.where("n >= least")


SWEEP_SQL = f"""WITH RECURSIVE {PTS}, t AS (SELECT CAST(unnest([0.88, 0.91, 0.95]) AS DOUBLE) AS t), strong AS (SELECT pts.*, t FROM pts JOIN t ON prob >= t),
links AS (SELECT a.t, a.point_id AS a, b.point_id AS b FROM strong a JOIN strong b ON a.t = b.t AND a.protein_key = b.protein_key AND {D2} <= 9.0),
walk AS (SELECT t, point_id AS id, point_id AS reach FROM strong UNION SELECT walk.t, walk.id, links.b FROM walk JOIN links ON walk.t = links.t AND walk.reach = links.a),
named AS (SELECT t, id, min(reach) AS cluster_id FROM walk GROUP BY t, id),
sized AS (SELECT named.t, protein_key, cluster_id, count(*) AS n, round(sum(prob*prob), 6) AS score FROM named JOIN strong ON named.t = strong.t AND id = point_id GROUP BY ALL HAVING count(*) >= 3)
SELECT t AS threshold, count(*) AS pockets, count(DISTINCT protein_key) AS proteins, round(avg(n), 6) AS mean_size, round(avg(score), 4) AS mean_score FROM sized GROUP BY t"""


@query(SWEEP_SQL)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The clustering at several thresholds in one job: cores only; ``threshold_sweep_iou`` has the full pipeline."""
    rows = _sweep(spark, sf, [(t, 3.0, 3) for t in (0.88, 0.91, 0.95)])
    return rows.groupBy("threshold").agg(F.count("*").alias("pockets"), F.countDistinct("protein_key").alias("proteins"), rounded(F.avg("n"), 6).alias("mean_size"), rounded(F.avg("score"), 4).alias("mean_score"))


def _swept(spark: SparkSession, sf: str, thresholds: tuple[float, ...], radii: tuple[float, ...], leasts: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points, ranked pockets, grown members and sites of all settings of a grid in one pass.

    A setting is ``threshold, radius, least``. Clusters and their growth are the
    same for every least size, so members carry the first two only. What lies
    within 3.5 A of a strong point is found once, for all settings.
    """
    pts = materialize(points(spark, sf), "points")
    strong = pts.where(F.col("prob") >= min(thresholds)).select("protein_key", "point_id", *spatial.AXES, "prob")
    by_t = strong.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where("prob >= threshold")
    rows = materialize(by_t.withColumn("g", F.concat_ws("|", "protein_key", F.col("threshold").cast("string"))), "sweep")
    parts = [graph.density_clusters(rows, "g", "point_id", r, 1, min(leasts)).withColumn("radius", F.lit(r)) for r in radii]
    core = materialize(reduce(DataFrame.unionByName, parts).join(rows.drop("prob"), ["g", "point_id"]).drop("g"), "core")
    near = materialize(spatial.radius_join(strong.drop("prob"), pts.select("protein_key", F.col("point_id").alias("member"), *spatial.AXES), "protein_key", 3.5).select("point_id", "member"), "near")
    keys = ["protein_key", "threshold", "radius", "cluster_id"]
    grown = materialize(core.select(*keys, "point_id").join(near, "point_id").select(*keys, F.col("member").alias("point_id")).distinct(), "grown")
    sums = grown.join(pts.select("point_id", "prob"), "point_id").groupBy(*keys).agg(rounded(F.sum(F.col("prob") * F.col("prob")), 6).alias("score"), F.count("*").alias("sample_points"))
    centre = core.groupBy(*keys).agg(F.count("*").alias("n"), *[rounded(F.avg(a), 5).alias(f"c{a}") for a in spatial.AXES])
    sized = sums.join(centre, keys).withColumn("least", F.explode(F.array(*[F.lit(m) for m in leasts]))).where("n >= least")
    ranked = graph.place(sized, ["protein_key", "threshold", "radius", "least"], F.desc("score"), "cluster_id")
    return pts, materialize(ranked, "ranked"), grown, materialize(_sites(pts), "site")


SETTING = ["threshold", "radius", "least"]


def _evaluated(ranked: DataFrame, grown: DataFrame, site: DataFrame) -> DataFrame:
    """Each setting's pockets against the sites: ``SETTING``, counts, R@1, R@3, mean IoU of the matches and precision; a setting without pockets has no row.

    Matches are one to one, by IoU from high to low, then by rank and size of
    the site, among pairs that overlap or whose centres lie within 6 A. Only
    such pairs are formed.
    """
    keys = ["protein_key", "threshold", "radius", "cluster_id"]
    sites = materialize(site.groupBy("protein_key", "site_id").agg(F.count("*").alias("ng"), *[rounded(F.avg(a), 5).alias(a) for a in spatial.AXES]), "sites")
    shared = grown.join(site.select("protein_key", "point_id", "site_id"), ["protein_key", "point_id"]).groupBy(*keys, "site_id").agg(F.count("*").alias("overlap"))
    centres = ranked.select(*keys, F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")).distinct()
    close = spatial.radius_join(centres, sites.select("protein_key", "site_id", *spatial.AXES), "protein_key", 6.0).select(*keys, "site_id", F.lit(0).cast("long").alias("overlap"))
    valid = materialize(shared.unionByName(close).groupBy(*keys, "site_id").agg(F.max("overlap").alias("overlap")), "valid")
    pairs = valid.join(ranked.select(*keys, "least", "rank", "sample_points"), keys).join(sites.select("protein_key", "site_id", "ng"), ["protein_key", "site_id"])
    pairs = pairs.withColumn("iou", F.col("overlap") / (F.col("sample_points") + F.col("ng") - F.col("overlap")))
    pairs = pairs.withColumn("pocket", F.struct(*SETTING, "cluster_id")).withColumn("place", F.struct(*SETTING, "site_id"))
    match = graph.greedy_match(pairs.select("protein_key", *SETTING, "pocket", "place", "rank", "ng", "iou"), "pocket", "place", [-F.col("iou"), F.col("rank"), -F.col("ng")])
    found = match.groupBy(*SETTING, "protein_key").agg(F.min("rank").alias("first"), F.count("*").alias("m"), F.sum("iou").alias("iou"))
    hits = found.groupBy(*SETTING).agg(F.sum("m").alias("matches"), F.sum("iou").alias("iou"), *[F.count_if(F.col("first") <= k).alias(f"hit{k}") for k in (1, 3)])
    made = ranked.groupBy(*SETTING).agg(F.count("*").alias("pockets"), F.countDistinct("protein_key").alias("proteins"))
    labelled = sites.select(F.countDistinct("protein_key")).scalar()
    rows = made.join(hits, SETTING, "left").fillna(0, ["matches", "iou", "hit1", "hit3"]).withColumn("labelled", labelled)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(*SETTING, "pockets", "proteins", "matches", share("hit1", "labelled").alias("recall_at_1"), share("hit3", "labelled").alias("recall_at_3"), share("iou", "matches").alias("mean_iou"), (F.col("matches") / (F.col("pockets") + 1e-8)).alias("precision"))


IOU_SWEEP_SQL = f"""WITH RECURSIVE {PTS}, {TRUTH}, t AS (SELECT CAST(unnest([0.88, 0.91, 0.95]) AS DOUBLE) AS t), strong AS (SELECT pts.*, t FROM pts JOIN t ON prob >= t),
links AS (SELECT a.t, a.point_id AS a, b.point_id AS b FROM strong a JOIN strong b ON a.t = b.t AND a.protein_key = b.protein_key AND {D2} <= 9.0),
walk AS (SELECT t, point_id AS id, point_id AS reach FROM strong UNION SELECT walk.t, walk.id, links.b FROM walk JOIN links ON walk.t = links.t AND walk.reach = links.a),
named AS (SELECT t, id, min(reach) AS cluster_id, count(*) AS n FROM walk GROUP BY t, id),
core AS (SELECT named.t, cluster_id, strong.protein_key, x, y, z FROM named JOIN strong ON named.t = strong.t AND id = point_id WHERE n >= 3),
grown AS (SELECT DISTINCT a.t, a.protein_key, a.cluster_id, b.point_id, b.prob FROM core a JOIN pts b ON a.protein_key = b.protein_key AND {D2} <= 3.5*3.5),
pocket AS (SELECT t, protein_key, cluster_id, count(*) AS np, round(sum(prob*prob), 6) AS score FROM grown GROUP BY ALL),
gs AS (SELECT protein_key, site_id, count(*) AS ng FROM site GROUP BY ALL),
shared AS (SELECT t, grown.protein_key, cluster_id, site_id, count(*) AS overlap FROM grown JOIN site ON grown.protein_key = site.protein_key AND grown.point_id = site.point_id GROUP BY ALL),
best AS (SELECT t.t, gs.protein_key, gs.site_id, coalesce(max(overlap / (np + ng - overlap)), 0) AS b FROM gs CROSS JOIN t LEFT JOIN shared ON shared.t = t.t AND shared.protein_key = gs.protein_key AND shared.site_id = gs.site_id LEFT JOIN pocket ON pocket.t = shared.t AND pocket.protein_key = shared.protein_key AND pocket.cluster_id = shared.cluster_id GROUP BY ALL),
per AS (SELECT t, protein_key, avg(b) AS b FROM best GROUP BY ALL),
means AS (SELECT t.t, round(sum(coalesce(b, 0)) / count(*), 6) AS mean_gt_iou FROM (SELECT DISTINCT protein_key FROM pts) a CROSS JOIN t LEFT JOIN per ON per.protein_key = a.protein_key AND per.t = t.t GROUP BY t.t),
made AS (SELECT t, count(*) AS pockets, count(DISTINCT protein_key) AS proteins, round(avg(np), 6) AS mean_size, round(avg(score), 4) AS mean_score FROM pocket GROUP BY t)
SELECT means.t AS threshold, coalesce(pockets, 0) AS pockets, coalesce(proteins, 0) AS proteins, mean_size, mean_score, mean_gt_iou, row_number() OVER (ORDER BY mean_gt_iou DESC, means.t) = 1 AS best FROM means LEFT JOIN made ON made.t = means.t"""


@query(IOU_SWEEP_SQL)
def threshold_sweep_iou(spark: SparkSession, sf: str) -> DataFrame:
    """The full pipeline at several thresholds: grown pockets, the mean over all proteins of their sites' best IoU (0 without sites), and the best threshold, the lowest of equals."""
    thresholds = (0.88, 0.91, 0.95)
    pts, ranked, grown, site = _swept(spark, sf, thresholds, (3.0,), (3,))
    sizes = site.groupBy("protein_key", "site_id").agg(F.count("*").alias("ng"))
    shared = grown.join(site.select("protein_key", "point_id", "site_id"), ["protein_key", "point_id"]).groupBy("protein_key", "threshold", "cluster_id", "site_id").agg(F.count("*").alias("overlap"))
    pairs = shared.join(ranked.select("protein_key", "threshold", "cluster_id", "sample_points"), ["protein_key", "threshold", "cluster_id"]).join(sizes, ["protein_key", "site_id"])
    hit = pairs.groupBy("protein_key", "threshold", "site_id").agg(F.max(F.col("overlap") / (F.col("sample_points") + F.col("ng") - F.col("overlap"))).alias("b"))
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    per = sizes.select("protein_key", "site_id", grid).join(hit, ["protein_key", "threshold", "site_id"], "left").groupBy("protein_key", "threshold").agg(F.avg(F.coalesce("b", F.lit(0.0))).alias("b"))
    means = pts.select("protein_key").distinct().select("protein_key", grid).join(per, ["protein_key", "threshold"], "left").groupBy("threshold").agg(rounded(F.avg(F.coalesce("b", F.lit(0.0))), 6).alias("mean_gt_iou"))
    made = ranked.groupBy("threshold").agg(F.count("*").alias("pockets"), F.countDistinct("protein_key").alias("proteins"), rounded(F.avg("sample_points"), 6).alias("mean_size"), rounded(F.avg("score"), 4).alias("mean_score"))
    out = means.join(made, "threshold", "left").fillna(0, ["pockets", "proteins"])
    first = Window.orderBy(F.desc("mean_gt_iou"), "threshold")  # one row a threshold
    return out.select("threshold", "pockets", "proteins", "mean_size", "mean_score", "mean_gt_iou", (F.row_number().over(first) == 1).alias("best"))


@query()
def config_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of thresholds, radii and sizes, each run to ranked pockets and held against the labelled sites; best first by .3 R@1 + .3 R@3 + .2 mean IoU + .2 precision."""
    grid = [(t, r, m) for t in (0.88, 0.91, 0.95) for r in (2.0, 3.0, 4.0) for m in (3, 5)]
    thresholds, radii, leasts = (tuple(sorted(set(c))) for c in zip(*grid))
    _, ranked, grown, site = _swept(spark, sf, thresholds, radii, leasts)
    settings = spark.createDataFrame(grid, "threshold double, radius double, least int")
    per = settings.join(_evaluated(ranked, grown, site), SETTING, "left").fillna(0)
    combined = rounded(0.3 * F.col("recall_at_1") + 0.3 * F.col("recall_at_3") + 0.2 * F.col("mean_iou") + 0.2 * F.col("precision"), 6)
    per = per.select(*SETTING, "pockets", "proteins", "matches", *[rounded(F.col(c), 6).alias(c) for c in ("recall_at_1", "recall_at_3", "mean_iou", "precision")], combined.alias("combined"))
    order = Window.orderBy(F.desc("combined"), *SETTING)  # one row a setting
    return per.withColumn("place", F.row_number().over(order))
