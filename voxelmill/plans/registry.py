"""The registry of named queries and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def nudged(sql: str) -> str:
    """SQL in which every ``round(x, n)`` is that of ``rounded``."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, k = 1, 0, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if sql[k] == "," and depth == 1:
                comma = k
            k += 1
        out.append(f"{sql[at:start]}round(({nudged(sql[start + 6 : comma])}) + 1e-9{sql[comma:k]}")
        at = k
    return "".join(out) + sql[at:]


def query(sql: str | None = None):
    """Registers a query under its function's name, with DuckDB's SQL for it if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = nudged(sql)
        return f

    return add


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Scored points with a place; repeated rows once."""
    cols = ("point_id", "protein_key", "point_idx", "chain_id", "residue_number", "residue_name", "x", "y", "z", "prob", "label")
    ok = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("x", "y", "z", "prob"))
    return table(spark, sf, "sas_points").select(*cols).where(ok).distinct()


PTS = """pts AS (
  SELECT DISTINCT point_id, protein_key, point_idx, chain_id, residue_number, residue_name, x, y, z, prob, label FROM sas_points
  WHERE x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND NOT isnan(y) AND z IS NOT NULL AND NOT isnan(z) AND prob IS NOT NULL AND NOT isnan(prob))"""


def residues(spark: SparkSession, sf: str) -> DataFrame:
    """Residues with a place; repeated rows once. prob is null where it is no probability."""
    rows = table(spark, sf, "residues").where("xyz IS NOT NULL AND size(xyz) = 3")
    prob = F.when(F.col("prob").between(0, 1), F.col("prob")).alias("prob")
    rows = rows.select("residue_uid", "protein_key", "res_id", F.col("xyz")[0].alias("x"), F.col("xyz")[1].alias("y"), F.col("xyz")[2].alias("z"), "rsa", prob)
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)").distinct()


RES = """res AS (
  SELECT DISTINCT residue_uid, protein_key, res_id, xyz[1] AS x, xyz[2] AS y, xyz[3] AS z, rsa, CASE WHEN prob BETWEEN 0 AND 1 THEN prob END AS prob FROM residues
  WHERE xyz IS NOT NULL AND len(xyz) = 3 AND xyz[1] IS NOT NULL AND xyz[2] IS NOT NULL AND xyz[3] IS NOT NULL AND NOT isnan(xyz[1]) AND NOT isnan(xyz[2]) AND NOT isnan(xyz[3]))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Points with a probability and a label: ``point_id, protein_key, p, y``."""
    rows = table(spark, sf, "sas_points").where("prob IS NOT NULL AND NOT isnan(prob) AND label IS NOT NULL")
    return rows.select("point_id", "protein_key", F.col("prob").alias("p"), F.col("label").alias("y")).distinct()


SCORED = """scored AS (
  SELECT DISTINCT point_id, protein_key, prob AS p, CAST(label AS INT) AS y FROM sas_points WHERE prob IS NOT NULL AND NOT isnan(prob) AND label IS NOT NULL)"""


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Pockets with a score: ``pocket_id, protein_key, seed_no, rank, score, sample_points``."""
    rows = table(spark, sf, "pockets").where("score IS NOT NULL AND NOT isnan(score)")
    return rows.select("pocket_id", "protein_key", "seed_no", "rank", "score", "sample_points", "pocket_volume", "surface_atoms").distinct()


PKT = """pkt AS (
  SELECT DISTINCT pocket_id, protein_key, seed_no, CAST(rank AS INT) AS rank, score, sample_points, pocket_volume, surface_atoms FROM pockets WHERE score IS NOT NULL AND NOT isnan(score))"""

#: Clusters of strong points: ``core(protein_key, point_id, cluster_id)``.
CLUSTERS = """strong AS (SELECT * FROM pts WHERE prob >= {least}),
links AS (SELECT a.point_id AS a, b.point_id AS b FROM strong a JOIN strong b ON a.protein_key = b.protein_key
  AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= {radius}*{radius}),
walk AS (SELECT point_id AS id, point_id AS reach FROM strong UNION SELECT walk.id, links.b FROM walk JOIN links ON walk.reach = links.a),
named AS (SELECT id, min(reach) AS cluster_id, count(*) AS n FROM walk GROUP BY id),
core AS (SELECT protein_key, point_id, cluster_id, x, y, z, prob, residue_number FROM named JOIN strong ON id = point_id WHERE n >= {size})"""
