"""Writers: feature and pocket files, summaries, sample stores and scripts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from voxelmill.functions.expressions import cell_text

# fixed values: columns of a pocket file
POCKET_COLUMNS = ("file", "#ligands", "#pockets", "pocket", "ligand", "rank", "score", "newRank", "oldScore", "zScoreTP", "probaTP", "samplePoints", "rawNewScore", "pocketVolume", "surfaceAtoms")


def feature_file(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """CSV in a fixed order of columns."""
    df.select(*order).write.mode("overwrite").csv(path, header=True)


def union_features(parts: Sequence[DataFrame], required: Sequence[str]) -> DataFrame:
    """Rows of all parts that have the required columns; columns that a part lacks are null."""
    usable = [p for p in parts if set(required) <= set(p.columns)]
    if not usable:
        raise ValueError("no part has the required columns")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), usable)


def pocket_file(df: DataFrame) -> DataFrame:
    """Pockets of the table's columns as cells of a pocket file, numbers with six digits, nulls empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [
        text("file_name"), text("n_ligands"), text("n_pockets"), text("pocket"), text("ligand"), text("rank"), cell_text(F.col("score")), text("new_rank"), cell_text(F.col("old_score")),
        cell_text(F.col("z_score_tp")), cell_text(F.col("proba_tp")), text("sample_points"), cell_text(F.col("raw_new_score")), cell_text(F.col("pocket_volume")), text("surface_atoms"),
    ]
    return df.select(*[c.alias(n) for c, n in zip(cells, POCKET_COLUMNS)])


def pocket_files(df: DataFrame, path: str) -> None:
    """A folder of pocket files for each protein."""
    pocket_file(df).withColumn("case", F.col("file")).write.mode("overwrite").partitionBy("case").csv(path, header=True)


def metric_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of metrics as rows ``metric, value``."""
    pairs = ", ".join(f"'{n}', cast(`{n}` AS double)" for n in names)
    return df.select(F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))


def summary_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, keys sorted."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def sample_store(df: DataFrame, path: str) -> None:
    """Samples by split, sorted by protein, so that readers skip what they don't ask for."""
    df.repartition("split", "protein_key").sortWithinPartitions("protein_key").write.mode("overwrite").partitionBy("split").parquet(path)


def view_script(df: DataFrame) -> DataFrame:
    """``protein_key, script``: a pseudo-atom line for every pocket centre, in order of rank."""
    line = F.format_string("pseudoatom pocket%d, pos=[%.3f, %.3f, %.3f]", F.col("rank").cast("int"), F.col("cx"), F.col("cy"), F.col("cz"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return df.groupBy("protein_key").agg(ordered.alias("l")).select("protein_key", F.concat_ws("\n", F.col("l.line")).alias("script"))
