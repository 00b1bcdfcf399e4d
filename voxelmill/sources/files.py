"""Lists, feature files, property tables, site texts and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxelmill.functions.expressions import stem


def dataset_list(lines: DataFrame, line: str = "line", order: str | None = None) -> DataFrame:
    """``entry``: lines of a list without blanks, ``#`` comments and ``PARAM.`` lines, each once; with ``order``, ``place`` is that of its first line."""
    rows = lines.select(F.trim(F.col(line)).alias("entry"), (F.col(order) if order else F.lit(None)).alias("place"))
    rows = rows.where((F.col("entry") != "") & ~F.col("entry").startswith("#") & ~F.col("entry").startswith("PARAM."))
    return rows.groupBy("entry").agg(F.min("place").alias("place")) if order else rows.select("entry").distinct()


def feature_csv(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """Feature files with a header, blanks as null, and the file's name. A chain keeps its rows and those without a chain."""
    df = spark.read.csv(path, header=True).withColumn("source_file", F.col("_metadata.file_name"))
    if chain is not None and "chain_id" in df.columns:
        df = df.where(F.col("chain_id").isNull() | (F.trim("chain_id") == "") | (F.upper(F.trim("chain_id")) == chain.upper()))
    return df


def has_features(df: DataFrame, required: list[str]) -> bool:
    """Whether a feature file can be used: all needed columns and a row."""
    return set(required) <= set(df.columns) and not df.isEmpty()


def property_table(spark: SparkSession, path: str) -> DataFrame:
    """A small dimension by atom name: numbers as doubles, null where they are none, white space behind commas ignored."""
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*[F.col(c) if c == "atomName" else F.col(c).try_cast("double").alias(c) for c in df.columns])


def site_text(lines: DataFrame, line: str = "line") -> DataFrame:
    """``protein_id, pocket_id, residues`` of lines ``protein pocket chain residue``; comments and short lines left out."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    rows = lines.where(~F.trim(F.col(line)).startswith("#")).select(parts.alias("p")).where(F.size("p") >= 4)
    rows = rows.select(F.col("p")[0].alias("protein_id"), F.col("p")[1].try_cast("int").alias("pocket_id"), F.col("p")[2].alias("chain"), F.col("p")[3].try_cast("int").alias("res_id")).where("pocket_id IS NOT NULL AND res_id IS NOT NULL")
    return rows.groupBy("protein_id", "pocket_id").agg(F.array_sort(F.collect_set(F.struct("chain", "res_id"))).alias("residues"))


def platt_settings(spark: SparkSession, path: str) -> tuple[float, float]:
    """a and b of a calibration file."""
    r = spark.read.json(path, multiLine=True).select(F.col("a").cast("double"), F.col("b").cast("double")).first()
    return r[0], r[1]


def index_payload(spark: SparkSession, path: str) -> DataFrame:
    """``index`` of a JSON file ``{"indices": [...]}``."""
    return spark.read.json(path, multiLine=True).select(F.explode("indices").alias("index"))


def best_checkpoint(names: DataFrame, name: str = "name", metric: str = "auprc") -> DataFrame:
    """The file name with the largest ``metric=<number>``; the first name where none tells it."""
    value = F.regexp_extract(F.col(name), rf"{metric}[=_]([0-9]+\.?[0-9]*)", 1).try_cast("double")
    rows = names.select(F.col(name).alias("n"), F.coalesce(value, F.lit(float("-inf"))).alias("v"))
    best = rows.groupBy("v").agg(F.min("n").alias("n")).agg(F.max(F.struct("v", "n")).alias("b"))
    return best.select(F.col("b.n").alias(name), F.col("b.v").alias(metric))


def newest(paths: DataFrame, path: str = "path", changed: str = "mtime") -> DataFrame:
    """The path that changed last."""
    return paths.agg(F.max_by(path, F.struct(changed, path)).alias(path))


def islands(df: DataFrame, key: str, order: str) -> DataFrame:
    """``key, island, first, last, n``: runs of equal keys in ``order``, an integer that is unique.

    Rows are ordered inside ranges only. How the ranges' runs are numbered, and
    which run goes on from one range into the next, follows from one row a range.
    """
    part = df.select(F.col(key).alias("k"), F.col(order).alias("o"))
    ends = part.agg(F.min("o").alias("a"), F.max("o").alias("b"), F.count("*").alias("n")).first()
    width = max(1, ((ends["b"] or 0) - (ends["a"] or 0) + 1) // max(1, (ends["n"] or 0) // 100_000 + 1))
    cut = part.withColumn("r", F.floor((F.col("o") - F.lit(ends["a"] or 0)) / width))
    inside = Window.partitionBy("r").orderBy("o")
    new = ((F.row_number().over(inside) == 1) | ~F.col("k").eqNullSafe(F.lag("k").over(inside))).cast("int")
    runs = cut.withColumn("new", new).withColumn("c", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    short = runs.groupBy("r", "c").agg(F.first("k").alias("k"), F.min("o").alias("first"), F.max("o").alias("last"), F.count("*").alias("n"))
    ranges = short.groupBy("r").agg(F.count("*").alias("m"), F.min_by("k", "c").alias("k0"), F.max_by("k", "c").alias("k1"))
    across = Window.orderBy("r")
    goes_on = (F.lag("r").over(across).isNotNull() & F.col("k0").eqNullSafe(F.lag("k1").over(across))).cast("int")
    ranges = ranges.withColumn("g", goes_on)
    base = F.coalesce(F.sum(F.col("m") - F.col("g")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = short.join(ranges.select("r", "g", base.alias("base")), "r").withColumn("island", F.col("base") + F.col("c") - F.col("g"))
    return numbered.groupBy("island").agg(F.first("k").alias(key), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def last_runs(df: DataFrame, key: str, order: str) -> DataFrame:
    """``key, first, last, n``: the last run of every key in ``order``, which is the one that a reader of ranges keeps."""
    runs = islands(df, key, order)
    best = runs.groupBy(key).agg(F.max(F.struct("first", "last", "n")).alias("b"))
    return best.select(key, "b.first", "b.last", "b.n")


def resolve(wanted: DataFrame, ident: str, candidates: list[Column], existing: DataFrame, path: str) -> DataFrame:
    """``ident, path``: of each id's candidates in turn the first that exists; ids without one have none."""
    tried = wanted.select(ident, F.posexplode(F.array(*candidates)).alias("_p", path))
    found = tried.join(existing.select(path).distinct(), path, "left_semi").groupBy(ident).agg(F.min(F.struct("_p", path)).alias("b"))
    return wanted.select(ident).distinct().join(found, ident, "left").select(ident, F.col(f"b.{path}").alias(path))


def substrings(text: Column, least: int, most: int) -> Column:
    """All different substrings of ``least`` to ``most`` signs: what an equi-join takes for a search by substring."""
    n = F.length(text)
    of = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.substring(text, at, size))
    sizes = F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), n)))
    return F.when(n >= least, F.array_distinct(F.flatten(F.transform(sizes, of)))).otherwise(F.array())


def file_keys(df: DataFrame, path: str) -> DataFrame:
    """Adds ``protein_id``, the file's stem in lower case without a chain."""
    return df.withColumn("protein_id", F.lower(F.regexp_replace(stem(F.col(path)), r"_[A-Za-z]{1,2}$", "")))
