"""Streams give what the batch queries give."""

from pyspark.sql import functions as F

from voxelmill.streaming import events

DATA = "/root/testdata/sf0.001/events.parquet"


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_hourly_stream(spark, tmp_path):
    rows = spark.read.parquet(DATA)
    rows.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    run(events.hourly(stream, "10000 days"), "hourly", "complete")
    key = lambda df: sorted((str(r["window"]["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("hourly")) == key(events.hourly(rows))


def test_scores_stream(spark, tmp_path):
    rows = spark.read.parquet(DATA)
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    run(events.scored(events.event_stream(spark, str(tmp_path / "in"))), "scores", "append")
    assert spark.table("scores").count() == rows.count()
    assert spark.table("scores").where("score IS NOT NULL AND (score <= 0 OR score >= 1)").count() == 0


def test_running_top_stream(spark, tmp_path):
    rows = spark.read.parquet(DATA)
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    run(events.running_top(events.event_stream(spark, str(tmp_path / "in"))), "tops", "update")
    got = {}
    for r in spark.table("tops").collect():
        got[r["user_id"]] = max(got.get(r["user_id"], []), list(r["best"]))
    want = {r["user_id"]: sorted(r["v"], reverse=True)[:3] for r in rows.where("value IS NOT NULL").groupBy("user_id").agg(F.collect_list("value").alias("v")).collect()}
    assert got == want
