"""Streaming forms of the scoring and aggregation queries; the batch queries use the same functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream; times get the session's zone, as watermarks need."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums of each hour and type; on a stream, events more than ``late`` behind are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events up to ``gap`` apart, itself included."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    # a session window ends before its gap is over; a microsecond more takes in events exactly that far apart
    return rows.groupBy(F.session_window("ts", f"{gap} 1 microsecond"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).withColumnRenamed("session_window", "session")


def scored(events: DataFrame, a: float = 0.05, b: float = -1.0) -> DataFrame:
    """Events with a calibrated score, row by row."""
    return events.withColumn("score", 1 / (1 + F.exp(-(F.col("value") * a + b))))


def running_top(events: DataFrame, n: int = 3) -> DataFrame:
    """The n highest values a user has shown so far, whenever they change; n values are the state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = list(state.get[0]) if state.exists else []
        before = list(best)
        for batch in batches:
            best = sorted([*best, *batch["value"].dropna().tolist()], reverse=True)[:n]
        state.update((best,))
        if best != before:
            yield pd.DataFrame({"user_id": [key[0]], "best": [best]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, best array<double>", "best array<double>", "update", "NoTimeout")
