"""Tables written to cut lineage.

They go to the shared folder that the cluster names in ``spark.checkpoint.dir``,
so the loss of an executor costs nothing but the tasks it ran. Only a session
that names no folder (a test on one machine) gets a temporary one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voxelmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for a table that the caller writes; deleted at exit."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = keep(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Deletes the written table behind ``df``, which no later step may read."""
    files = set(df.inputFiles())
    for entry in list(_written):
        if any(entry[1].split("://")[-1] in f for f in files):
            _written.remove(entry)
            _delete(*entry)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may already be down
            pass
