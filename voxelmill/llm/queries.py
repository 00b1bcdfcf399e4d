"""Queries p1 to p9 over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelmill.functions.keys import bare_name, entry_code, entry_code_sql
from voxelmill.llm import cutoffs, group_split, mixing, overlap, spectral, stuffing, topn, vector_index, vector_neighbours
from voxelmill.llm.bpe import encode_corpus
from voxelmill.sources.tables import table
from voxelmill.storage import materialize

# fixed values: what stands for no lab, once case, white space and punctuation are gone
NO_LAB = ("", "na", "unknown")
SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, sf, "pockets"), "protein_key", "pocket_id", "score", "rank", 5).select("protein_key", "pocket_id")


def p1_top_pockets(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, sf, "pockets"), "protein_key", "pocket_id", "score", "rank", 5)


P1 = """
WITH once AS (
  SELECT DISTINCT ON (protein_key, pocket_id) protein_key, pocket_id, score, CAST(rank AS BIGINT) AS rank FROM pockets
  WHERE protein_key IS NOT NULL AND pocket_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) ORDER BY protein_key, pocket_id, score DESC, rank ASC NULLS LAST),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY protein_key ORDER BY score DESC, rank ASC NULLS LAST, pocket_id) AS INT) AS place FROM once)
SELECT {} FROM placed WHERE place <= 5"""


def _evaluation(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda name, split: table(spark, sf, name).withColumn("split_name", F.lit(split))
    return part("val_ids", "val").unionByName(part("test_ids", "test"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf, "train_ids"), _evaluation(spark, sf), "row_id", "protein_id", "residue_seq")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.read_records(table(spark, sf, "train_ids"), _evaluation(spark, sf), "row_id", "protein_id", "residue_seq")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    records = _listed(spark, sf)
    hits = overlap.overlapping(*overlap.near_classes(records)).union(overlap.overlapping(*overlap.entry_classes(records)))
    return overlap.overlap_report(hits, _evaluation(spark, sf), "row_id", "split_name", "source")


def p2_near_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different sequences, each named after its smallest record."""
    pairs, _ = overlap.near_classes(_listed(spark, sf))
    return pairs.where("t <> e").select(F.col("t").alias("train_class"), F.col("e").alias("eval_class"))


def p2_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with a sequence, its class and the number of classes of the other side that are near it, itself included where it stands on both sides."""
    pairs, members = overlap.near_classes(_listed(spark, sf))
    pairs = materialize(pairs, "pairs")
    links = pairs.groupBy(F.col("t").alias("class")).agg(F.count("*").alias("n")).withColumn("train", F.lit(True)).union(pairs.groupBy(F.col("e").alias("class")).agg(F.count("*").alias("n")).withColumn("train", F.lit(False)))
    return members.join(links, ["class", "train"], "left").select(F.col("r").alias("row_id"), F.col("class").alias("class_no"), F.coalesce("n", F.lit(0)).alias("links"))


P2 = f"""
WITH recs AS (
  SELECT row_id, {entry_code_sql("protein_id")} AS entry, nullif(upper(regexp_replace(residue_seq, '[\\s*]+', '', 'g')), '') AS seq, split, source
  FROM (SELECT *, 'train' AS split FROM train_ids UNION ALL SELECT *, 'val' FROM val_ids UNION ALL SELECT *, 'test' FROM test_ids)),
pairs AS (
  SELECT t.row_id AS t, e.row_id AS e FROM recs t JOIN recs e ON t.entry = e.entry WHERE t.split = 'train' AND e.split <> 'train'
  UNION
  SELECT t.row_id, e.row_id FROM recs t JOIN recs e ON abs(length(t.seq) - length(e.seq)) <= greatest(length(t.seq), length(e.seq)) // 10
  WHERE t.split = 'train' AND e.split <> 'train' AND levenshtein(t.seq, e.seq) <= greatest(length(t.seq), length(e.seq)) // 10)
"""
P2_CLASSES = """
WITH recs AS (
  SELECT row_id, nullif(upper(regexp_replace(residue_seq, '[\\s*]+', '', 'g')), '') AS seq, train
  FROM (SELECT *, true AS train FROM train_ids UNION ALL SELECT *, false FROM val_ids UNION ALL SELECT *, false FROM test_ids)),
class AS (SELECT seq, min(row_id) AS class_no, bool_or(train) AS t, bool_or(NOT train) AS e FROM recs WHERE seq IS NOT NULL GROUP BY seq),
near AS (SELECT a.class_no AS t, b.class_no AS e FROM class a JOIN class b ON abs(length(a.seq) - length(b.seq)) <= greatest(length(a.seq), length(b.seq)) // 10
  WHERE a.t AND b.e AND levenshtein(a.seq, b.seq) <= greatest(length(a.seq), length(b.seq)) // 10)
"""
P2_NEAR = P2_CLASSES + "SELECT t AS train_class, e AS eval_class FROM near WHERE t <> e"
P2_MEMBERS = P2_CLASSES + """SELECT row_id, class_no, (SELECT count(*) FROM near WHERE CASE WHEN recs.train THEN near.t ELSE near.e END = class_no) AS links
FROM recs JOIN class USING (seq)"""
P2_FOUND = P2 + "SELECT least(t, e) AS row_id_a, greatest(t, e) AS row_id_b FROM pairs"
P2_REPORT = P2 + """SELECT split, lower(trim(source)) AS source, count(*) AS records, count(*) FILTER (WHERE row_id IN (SELECT e FROM pairs)) AS overlapping
FROM recs WHERE split <> 'train' GROUP BY 1, 2"""


def _related(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lab = bare_name(F.col("lab"))
    chains = table(spark, sf, "proteins").select("protein_no", entry_code(F.col("protein_key")).alias("entry"), F.when(~lab.isin(*NO_LAB), lab).alias("lab"))
    return group_split.related_groups(materialize(chains.distinct(), "chains"), "protein_no", ["entry", "lab"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf)[0].where("size > 1").select("group_no", F.col("id").alias("protein_no"))


def p3_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of at least two by their spanning tree: its edges, all inside the group, and the smallest and largest chain that they touch."""
    groups, forest = _related(spark, sf)
    name = groups.select("id", "group_no")
    ends = forest.join(name.withColumnRenamed("id", "a"), "a").join(name.select(F.col("id").alias("b"), F.col("group_no").alias("other")), "b").where("group_no = other")
    return ends.groupBy("group_no").agg(F.count("*").alias("edges"), F.min(F.least("a", "b")).alias("least"), F.max(F.greatest("a", "b")).alias("largest"))


def _dealt(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chains = materialize(_related(spark, sf)[0], "related")
    return chains, group_split.deal_groups(chains.select("group_no", "size").distinct(), SHARES)


def p3_split(spark: SparkSession, sf: str) -> DataFrame:
    chains, dealt = _dealt(spark, sf)
    return chains.join(dealt.select("group_no", "split"), "group_no").select(F.col("id").alias("protein_no"), "group_no", "split")


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    _, dealt = _dealt(spark, sf)
    sums = dealt.groupBy("split").agg(F.sum("size").alias("chains"), F.count("*").alias("groups"))
    whole = F.sum("chains").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # a row a split
    return sums.select("split", "chains", "groups", F.round(F.col("chains") / whole, 4).alias("share"))


P3 = f"""
WITH RECURSIVE chains AS (
  SELECT DISTINCT protein_no, {entry_code_sql("protein_key")} AS entry, lower(regexp_replace(lab, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS lab FROM proteins),
keys AS (
  SELECT protein_no, 'e' || entry AS k FROM chains WHERE entry IS NOT NULL UNION
  SELECT protein_no, 'l' || lab FROM chains WHERE lab NOT IN ('', 'na', 'unknown')),
edges AS (SELECT DISTINCT a.protein_no AS a, b.protein_no AS b FROM keys a JOIN keys b USING (k)),
walk AS (SELECT protein_no AS id, protein_no AS reach FROM chains UNION SELECT walk.id, edges.b FROM walk JOIN edges ON walk.reach = edges.a),
named AS (SELECT id, min(reach) AS group_no, count(*) AS size FROM walk GROUP BY id)
"""
P3_FOUND = P3 + "SELECT group_no, id AS protein_no FROM named WHERE size > 1"
P3_FOREST = P3 + "SELECT group_no, count(*) - 1 AS edges, min(id) AS least, max(id) AS largest FROM named WHERE size > 1 GROUP BY group_no"


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    near = vector_neighbours.nearest_vectors(table(spark, sf, "sas_points"), "protein_key", "point_id", ["x", "y", "z"], 3, paired=True)
    return near.select(F.col("a").alias("point_id_a"), F.col("b").alias("point_id_b"))


P4_FOUND = """
WITH pts AS (
  SELECT DISTINCT ON (point_id) protein_key, point_id, x, y, z FROM sas_points
  WHERE protein_key IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)),
near AS (
  SELECT a.point_id AS a, b.point_id AS b,
    rank() OVER (PARTITION BY a.point_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS r
  FROM pts a JOIN pts b ON a.protein_key = b.protein_key AND a.point_id <> b.point_id)
SELECT DISTINCT least(a, b) AS point_id_a, greatest(a, b) AS point_id_b FROM near WHERE r <= 3"""


def p4_neighbour_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Three neighbours of every point, nearest first, ties by index: a row each."""
    points = table(spark, sf, "sas_points")
    near = vector_neighbours.nearest_vectors(points, "protein_key", "point_id", ["x", "y", "z"], 3)
    index = points.select("point_id", "protein_key", "point_idx").where("point_id IS NOT NULL").dropDuplicates(["point_id"])
    named = near.join(index.select(F.col("point_id").alias("b"), "point_idx"), "b").select("a", F.round("distance", 6).alias("neighbor_distance"), F.col("point_idx").alias("neighbor_idx"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("neighbor_distance", "neighbor_idx"))
    three = named.withColumn("place", place).where("place <= 3")
    return three.join(index.select(F.col("point_id").alias("a"), "protein_key", "point_idx"), "a").select("protein_key", "point_idx", "place", "neighbor_idx", "neighbor_distance")


P4_ROWS = """
WITH pts AS (
  SELECT DISTINCT ON (point_id) protein_key, point_id, point_idx, x, y, z FROM sas_points
  WHERE protein_key IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)),
near AS (
  SELECT a.protein_key, a.point_id, a.point_idx, b.point_idx AS neighbor_idx, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 6) AS neighbor_distance
  FROM pts a JOIN pts b ON a.protein_key = b.protein_key AND a.point_id <> b.point_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY neighbor_distance, neighbor_idx) AS INT) AS place FROM near)
SELECT protein_key, point_idx, place, neighbor_idx, neighbor_distance FROM placed WHERE place <= 3"""


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of ``sample_store`` anew."""
    entry = F.struct("place", "neighbor_idx", "neighbor_distance")
    lists = p4_neighbour_rows(spark, sf).groupBy("protein_key", "point_idx").agg(F.array_sort(F.collect_list(entry)).alias("n"))
    return lists.select("protein_key", "point_idx", F.col("n.neighbor_idx").alias("neighbor_idx"), F.col("n.neighbor_distance").alias("neighbor_distances"))


def _embedding_index(spark: SparkSession, sf: str) -> vector_index.Index:
    return vector_index.build_index(table(spark, sf, "embeddings"), "vec_id", "embedding")


def p4_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The three most similar vectors of every twentieth, out of all of ``embeddings``, with as many probes as nine tenths of the true ones take."""
    index = _embedding_index(spark, sf)
    probes, _ = vector_index.measure_recall(index, 3)
    near = vector_index.search_index(index, table(spark, sf, "embeddings").where("vec_id % 20 = 0"), "vec_id", "embedding", 3, probes)
    return near.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour"), F.round("score", 6).alias("similarity"), "place")


def p4_embedding_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed rows, lists, probes and the recall that these reach, measured against brute force."""
    index = _embedding_index(spark, sf)
    probes, recall = vector_index.measure_recall(index, 3)
    return index.rows.agg(F.count("*").alias("rows")).select("rows", F.lit(len(index.book.lists)).alias("lists"), F.lit(probes).alias("probes"), F.lit(recall).alias("recall"))


def _cut(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return cutoffs.cutoffs(table(spark, sf, "residues"), "source", "residue_uid", "prob", table(spark, sf, "pocket_config"), "source", "target_prevalence")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf)[1].select("source", "residue_uid")


def p5_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf)[0]


P5 = """
WITH once AS (
  SELECT DISTINCT residue_uid, lower(trim(source)) AS source, prob FROM residues WHERE prob >= 0 AND prob <= 1),
share AS (
  SELECT lower(trim(source)) AS source, target_prevalence AS share FROM pocket_config WHERE target_prevalence IS NOT NULL),
placed AS (
  SELECT once.source, residue_uid, prob, share, count(*) OVER (PARTITION BY once.source) AS n, row_number() OVER (PARTITION BY once.source ORDER BY prob DESC) AS r
  FROM once JOIN share ON once.source = share.source),
cut AS (SELECT source, n, greatest(1, CAST(floor(n * share) AS BIGINT)) AS k, prob AS cutoff FROM placed WHERE r = greatest(1, CAST(floor(n * share) AS BIGINT)))
"""
P5_FOUND = P5 + "SELECT placed.source, residue_uid FROM placed JOIN cut ON placed.source = cut.source WHERE prob >= cutoff"
P5_CUTOFFS = P5 + "SELECT cut.source, cut.n, k, cutoff, count(*) AS kept FROM placed JOIN cut ON placed.source = cut.source WHERE prob >= cutoff GROUP BY ALL"


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.similarity_clusters(table(spark, sf, "sas_points"), "protein_key", "point_id", ["x", "y", "z"], "prob", 0.88, 3.0, 3)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sites(spark, sf).select("cluster_id", "point_id")


def p6_sites(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.describe_clusters(_sites(spark, sf), "protein_key", "point_id")


def p6_typical(spark: SparkSession, sf: str) -> DataFrame:
    """The three most typical points of every site, a row each."""
    return spectral.typical_members(_sites(spark, sf), "protein_key", "point_id").select("protein_key", "cluster_id", "size", "place", "point_id", F.round("affinity", 6).alias("affinity"))


P6 = """
WITH RECURSIVE pts AS (
  SELECT DISTINCT ON (point_id) protein_key, point_id, x, y, z FROM sas_points
  WHERE protein_key IS NOT NULL AND prob >= 0.88 AND NOT isnan(prob) AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)),
edges AS (
  SELECT a.point_id AS a, b.point_id AS b FROM pts a JOIN pts b
  ON a.protein_key = b.protein_key AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 9.0),
walk AS (SELECT point_id AS id, point_id AS reach FROM pts UNION SELECT walk.id, edges.b FROM walk JOIN edges ON walk.reach = edges.a),
named AS (SELECT id, min(reach) AS cluster_id, count(*) AS size FROM walk GROUP BY id)
"""
P6_FOUND = P6 + "SELECT cluster_id, id AS point_id FROM named WHERE size >= 3"
P6_TYPICAL = P6 + """, felt AS (SELECT a.protein_key, a.point_id, sum(CASE WHEN a.point_id = b.point_id THEN 0.0 ELSE exp(-((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) / 18) END) AS affinity
  FROM pts a JOIN pts b ON a.protein_key = b.protein_key AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 9.0 GROUP BY ALL),
placed AS (SELECT protein_key, cluster_id, size, point_id, affinity, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY round(affinity, 9) DESC, point_id) AS INT) AS place FROM named JOIN felt ON id = point_id WHERE size >= 3)
SELECT protein_key, cluster_id, size, place, point_id, round(affinity, 6) AS affinity FROM placed WHERE place <= 3"""


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, sf: str, total: str | None = "corpus") -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, sf, "documents"), "doc_id", "text", "source", table(spark, sf, "mix_targets"), "source", "target_weight", "max_repeats", total=total)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """As many tokens as the corpus has; sources that can't give their share give all they may."""
    return _mix(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p8_exact_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The largest mix in which every source that has texts has its share."""
    return _mix(spark, sf, None)[0]


def p8_exact_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf, None)[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf, "documents"), "doc_id", "text", "lang").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_top_pockets, p2_found, p2_report, p2_near_classes, p2_members, p3_found, p3_forest, p3_split, p3_shares, p4_found, p4_neighbours, p4_neighbour_rows, p4_embeddings, p4_embedding_recall, p5_found, p5_cutoffs, p6_found, p6_sites, p6_typical, p7_ids, p8_mix, p8_shares, p8_exact_mix, p8_exact_shares, p9_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1.format("protein_key, pocket_id"), "p1_top_pockets": P1.format("protein_key, pocket_id, score, rank, place"),
        "p2_found": P2_FOUND, "p2_report": P2_REPORT, "p2_near_classes": P2_NEAR, "p2_members": P2_MEMBERS, "p3_found": P3_FOUND, "p3_forest": P3_FOREST, "p4_found": P4_FOUND, "p4_neighbour_rows": P4_ROWS,
        "p5_found": P5_FOUND, "p5_cutoffs": P5_CUTOFFS, "p6_found": P6_FOUND, "p6_typical": P6_TYPICAL,
    }
