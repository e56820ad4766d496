"""Streams give what the batch gives."""

import os

from pyspark.sql import functions as F

from foliant.operators import jobs
from foliant.sources import tables
from foliant.streaming import streams


def events(spark, sf, tmp_path):
    path = f"{tmp_path}/events"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(path)
    return path


def test_window_counts(spark, sf, tmp_path):
    path = events(spark, sf, tmp_path)
    streams.to_table(streams.window_counts(streams.request_stream(spark, path)), "counts", f"{tmp_path}/c", "complete")
    batch = tables.requests(spark, sf).groupBy(F.window("at", "1 day").alias("w"), "endpoint").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), "endpoint", "n")
    assert {tuple(r) for r in spark.table("counts").select("begins", "endpoint", "n").collect()} == {tuple(r) for r in batch.collect()}


def test_late_rows_drop_out(spark, tmp_path):
    schema = "ts timestamp_ntz, event_type string, value double"
    for i, t in enumerate(("2024-01-10", "2024-01-15", "2024-01-01", "2024-01-20")):
        folder = tmp_path / str(i)
        spark.createDataFrame([(t, "view", 1.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(folder))
        file = next(folder.glob("part-*"))
        (tmp_path / "e").mkdir(exist_ok=True)
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)
        file.rename(tmp_path / "e" / f"{i}.parquet")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    stream = streams.window_counts(events.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("endpoint"), F.col("value").alias("duration_s")))
    streams.to_table(stream, "late", f"{tmp_path}/c")
    assert [str(r.begins)[:10] for r in spark.table("late").orderBy("begins").collect()] == ["2024-01-10", "2024-01-15"]


def test_rate_limit(spark, sf, tmp_path):
    path = events(spark, sf, tmp_path)
    streams.to_table(streams.rate_limited(streams.request_stream(spark, path), 5, 86_400), "limited", f"{tmp_path}/c")
    assert {tuple(r) for r in spark.table("limited").collect()} == {tuple(r) for r in jobs.admitted(tables.requests(spark, sf), 5, 86_400).collect()}


def test_sessions(spark, sf, tmp_path):
    path = events(spark, sf, tmp_path)
    streams.to_table(streams.last_activity(streams.request_stream(spark, path)), "sessions", f"{tmp_path}/c", "complete")
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == 1000


def test_rate_limit_forgets_clients(spark, tmp_path):
    """Clients that the watermark has left behind are no state any more; those within the window are."""
    folder = tmp_path / "e"
    folder.mkdir()
    for i, rows in enumerate([[(1, 1, 0), (2, 1, 10), (3, 2, 20)], [(4, 3, 100_000)], [(5, 1, 100_005), (6, 3, 100_010)]]):
        out = tmp_path / str(i)
        spark.createDataFrame(rows, "request_id long, client long, s long").select("request_id", "client", F.timestamp_seconds(F.col("s") + 1000).alias("at")).coalesce(1).write.parquet(str(out))
        file = next(out.glob("part-*"))
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)
        file.rename(folder / f"{i}.parquet")
    stream = spark.readStream.schema("request_id long, client long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    streams.to_table(streams.rate_limited(stream, 1, 60), "forgetful", f"{tmp_path}/c")
    assert {(r.request_id, r.admitted) for r in spark.table("forgetful").collect()} == {(1, True), (2, False), (3, True), (4, True), (5, True), (6, False)}
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/c")
    assert {r.key.client for r in state.collect()} <= {1, 3}
