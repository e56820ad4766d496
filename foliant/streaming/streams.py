"""Streams of requests: windowed counts, latest states, and exact rate limits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliant.streaming.states import ROCKSDB


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests from the files of a folder; the times are cast, as a watermark needs an instant."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path)
    return events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("endpoint"), (F.col("value") / 1000).alias("duration_s"))


def window_counts(requests: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests and time by endpoint and window; a window closes when the watermark passes it."""
    counted = requests.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "endpoint").agg(F.count("*").alias("n"), F.round(F.sum("duration_s"), 6).alias("seconds"))
    return counted.select(F.col("w.start").alias("begins"), "endpoint", "n", "seconds")


def last_activity(requests: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of clients: a session ends with a gap of silence."""
    sessions = requests.withWatermark("at", late).groupBy("client", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.max("at").alias("last_activity"))
    return sessions.select("client", F.col("w.start").alias("begins"), "last_activity", "n")


class RateLimit(StatefulProcessor):
    """Of a client the times of its admitted requests, as many as the limit at most; a timer forgets them when none counts any more."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("kept", "kept array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        kept = list(self.state.get()[0]) if self.state.exists() else []
        for r in sorted(rows, key=lambda r: (r.s, r.request_id)):
            kept = [t for t in kept if r.s - t < self.seconds]
            ok = len(kept) < self.limit
            if ok:
                kept.append(r.s)
            yield Row(request_id=r.request_id, client=key[0], admitted=ok)
        self.state.update((kept,))
        if kept:
            self.handle.registerTimer(1000 * (kept[-1] + self.seconds))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        kept = self.state.get()[0] if self.state.exists() else []
        if not len(kept) or 1000 * (kept[-1] + self.seconds) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())


def rate_limited(requests: DataFrame, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Each request and whether it is admitted: fewer than `limit` admitted ones of the client in the last `seconds`.

    A client's requests are taken in order within what has arrived; what is more than `late` behind is dropped. A client is
    forgotten when the watermark has passed its last admitted request by `seconds`.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stamped = requests.withWatermark("at", late).select("request_id", "client", "at", F.unix_timestamp("at").alias("s"))
    return stamped.groupBy("client").transformWithState(RateLimit(limit, seconds), "request_id long, client long, admitted boolean", "Append", "EventTime")


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, into an in-memory table: for batch comparisons and tests."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

