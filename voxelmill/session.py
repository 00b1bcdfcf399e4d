"""Session factory used by tests, the benchmark and interactive work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "voxelmill", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    builder = builder.config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
