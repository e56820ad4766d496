"""Jobs as a state machine over a stream of events: legal transitions, a time limit, retries, and state that expires."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

# Which status may follow which, the limit's text, seconds of the limit, attempts after the first.
FOLLOWS = {"pending": ("processing", "failed", "cancelled"), "processing": ("completed", "failed", "cancelled"), "failed": ("processing",), "completed": (), "cancelled": ()}
TIMED_OUT, TIME_LIMIT, RETRIES = "Processing time limit exceeded", 600, 3
#: Seconds for which a job that ended is remembered.
REMEMBER = 86_400
#: job_id, the time it holds from, from and to, whether it was accepted and if not why, the job's error.
TRANSITION = "job_id long, ms long, from_status string, to_status string, accepted boolean, reason string, error string"
STATE = "status string, since long, attempts int"
STATE_FIELDS = "status: string, since: long, attempts: int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def overdue(state: tuple, now: int, limit: int) -> tuple | None:
    """The state that a job under way has after its time limit, if it has passed at `now`."""
    status, since, attempts = state
    return ("failed", since + 1000 * limit, attempts) if status == "processing" and now >= since + 1000 * limit else None


def follow(state: tuple, ms: int, to: str, retries: int) -> tuple[tuple, str | None]:
    """The state after an event, and why it was refused if it was."""
    status, since, attempts = state
    if ms < since:
        return state, "late"
    if to not in FOLLOWS.get(status, ()):
        return state, "not allowed"
    if status == "failed" and attempts > retries:
        return state, "no retries left"
    return (to, ms, attempts + (to == "processing")), None


class JobStates(StatefulProcessor):
    """One state a job: its status, since when, and its attempts. A timer ends what takes too long; another forgets what ended."""

    def __init__(self, limit: int, retries: int, remember: int):
        self.limit, self.retries, self.remember = limit, retries, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.state.get()
        before = state = tuple(held) if held is not None else ("pending", 0, 0)
        # Timers fire after a batch's rows: what the watermark has ended or forgotten by now must not meet them.
        now = timerValues.getCurrentWatermarkInMs()
        if late := overdue(state, now, self.limit):
            yield _transition(key[0], late[1], state[0], "failed", None, TIMED_OUT)
            state = late
        if state[0] not in ("pending", "processing") and now >= state[1] + 1000 * self.remember:
            state = ("pending", 0, 0)
        for r in sorted(rows, key=lambda r: (r.ms, r.seq)):
            if late := overdue(state, r.ms, self.limit):
                yield _transition(key[0], late[1], state[0], "failed", None, TIMED_OUT)
                state = late
            after, refused = follow(state, r.ms, r.status, self.retries)
            yield _transition(key[0], r.ms, state[0], r.status, refused, r.error if not refused and r.status == "failed" else None)
            state = after
        if state != before:
            self.state.update(state)
            self.handle.registerTimer(state[1] + 1000 * (self.limit if state[0] == "processing" else self.remember))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        state, now = tuple(self.state.get()), expiredTimerInfo.getExpiryTimeInMs()
        if late := overdue(state, now, self.limit):
            yield _transition(key[0], late[1], state[0], "failed", None, TIMED_OUT)
            self.state.update(late)
            self.handle.registerTimer(late[1] + 1000 * self.remember)
        elif state[0] != "processing" and now >= state[1] + 1000 * self.remember:
            self.state.clear()


def _transition(job_id: int, ms: int, before: str, to: str, refused: str | None, error: str | None) -> Row:
    return Row(job_id=job_id, ms=ms, from_status=before, to_status=to, accepted=refused is None, reason=refused, error=error)


def job_transitions(events: DataFrame, *, late: str = "1 hour", limit: int = TIME_LIMIT, retries: int = RETRIES, remember: int = REMEMBER) -> DataFrame:
    """Each transition of each job, streamed out: job_id, at, from_status, to_status, accepted, reason, error.

    events (job_id, at, seq, status, error): what is asked of a job, a table or a stream. A job's events are taken in
    the order of (at, seq) within what has arrived; one that is older than the job's state is refused as late, one that
    doesn't follow from it as not allowed. A job that is processing for `limit` seconds has failed then, whether the next event
    tells or the watermark, which also drops what is more than `late` behind. A failed job may begin again `retries` times.
    `remember` seconds after its last transition a job is forgotten, so that the state holds recent jobs only.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stamped = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    asked = stamped.select("job_id", "at", F.unix_millis("at").alias("ms"), "seq", "status", "error")
    out = asked.groupBy("job_id").transformWithState(JobStates(limit, retries, remember), TRANSITION, "Append", "EventTime")
    return out.select("job_id", F.timestamp_millis("ms").alias("at"), "from_status", "to_status", "accepted", "reason", "error")


def current(transitions: DataFrame) -> DataFrame:
    """By job the status that its accepted transitions lead to: job_id, status, at, attempts, error."""
    order = F.struct("at", (F.col("from_status") == "processing").cast("int"))
    ok = transitions.where("accepted")
    last = F.max_by(F.struct("to_status", "at", "error"), order)
    return ok.groupBy("job_id").agg(last.alias("l"), F.count_if(F.col("to_status") == "processing").alias("attempts")).select("job_id", F.col("l.to_status").alias("status"), F.col("l.at").alias("at"), "attempts", F.col("l.error").alias("error"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, appended to Parquet files exactly once; the files as a table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)


#: Transitions of a job as they are stored with its state, and a batch's rows: job_id and what its events led to.
OUT = "array<struct<ms: long, from_status: string, to_status: string, accepted: boolean, reason: string, error: string>>"
FOLDED = f"job_id long, f struct<status: string, since: long, attempts: int, out: {OUT}>"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _state(status: Column, since: Column, attempts: Column) -> list[Column]:
    return [status.alias("status"), since.alias("since"), attempts.alias("attempts")]


def _moved(ms: Column, before: Column, to: Column, why: Column, error: Column) -> Column:
    return F.struct(ms.alias("ms"), before.alias("from_status"), to.alias("to_status"), why.isNull().alias("accepted"), why.alias("reason"), error.alias("error"))


def _ticked(s: Column, ms: Column, limit: int) -> Column:
    """`overdue` of a state as columns: the state at `ms`, and the transition as `out`, null if there is none."""
    ends = s.since + 1000 * limit
    late, none = (s.status == "processing") & (ms >= ends), F.lit(None).cast("string")
    return F.struct(*_state(F.when(late, "failed").otherwise(s.status), F.when(late, ends).otherwise(s.since), s.attempts), F.when(late, _moved(ends, s.status, F.lit("failed"), none, F.lit(TIMED_OUT))).alias("out"))


def _folded(events: Column, state: Column, now: int, limit: int, retries: int) -> Column:
    """A job's events (ms, seq, status, error) in their order, from a state on, and the watermark behind them: state and `out`, as JobStates has them.

    Many events are taken in parts, about as many as each has: an array that grows by one is copied each time.
    """
    nothing = F.array().cast(OUT)
    legal = lambda s, to: F.coalesce(reduce(or_, ((s.status == a) & to.isin(*b) for a, b in FOLLOWS.items() if b)), F.lit(False))

    def step(a: Column, e: Column) -> Column:
        refused = lambda s: F.when(e.ms < s.since, "late").when(~legal(s, e.status), "not allowed").when((s.status == "failed") & (s.attempts > retries), "no retries left")

        def asked(s: Column, why: Column) -> Column:
            ok = why.isNull()
            told = _moved(e.ms, s.status, e.status, why, F.when(ok & (e.status == "failed"), e.error))
            tried = s.attempts + F.when(ok & (e.status == "processing"), 1).otherwise(0)
            return F.struct(*_state(F.when(ok, e.status).otherwise(s.status), F.when(ok, e.ms).otherwise(s.since), tried), F.concat(a.out, F.array_compact(F.array(s.out, told))).alias("out"))

        return _let(_ticked(a, e.ms, limit), lambda s: _let(refused(s), lambda why: asked(s, why)))

    def part(a: Column, es: Column) -> Column:
        of = F.aggregate(es, F.struct(*_state(a.status, a.since, a.attempts), nothing.alias("out")), step)
        return _let(of, lambda b: F.struct(*_state(b.status, b.since, b.attempts), F.concat(a.parts, F.array(b.out)).alias("parts")))

    length = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(events))).cast("int"))
    parts = _let(F.sort_array(events), lambda es: F.transform(F.filter(F.sequence(F.lit(1), F.size(es) + 1, length), lambda i: i <= F.size(es)), lambda i: F.slice(es, i, length)))
    start = F.struct(*_state(F.coalesce(state.status, F.lit("pending")), F.coalesce(state.since, F.lit(0).cast("long")), F.coalesce(state.attempts, F.lit(0))), F.array().cast(f"array<{OUT}>").alias("parts"))
    ended = lambda a: _let(_ticked(a, F.lit(now).cast("long"), limit), lambda s: F.struct(*_state(s.status, s.since, s.attempts), F.concat(F.flatten(a.parts), F.array_compact(F.array(s.out))).alias("out")))
    return F.aggregate(parts, start, part, ended)


def to_batches(path: str, *, late_s: int = 3600, limit: int = TIME_LIMIT, retries: int = RETRIES, remember: int = REMEMBER) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's events meet the states of the batch before, in one shuffle, as `<path>/jobs/batch=<number>` (FOLDED).

    Watermarks are as job_transitions has them: what a batch leaves stands as the watermark behind it would leave it. A batch that is run again overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        asked = batch.where(F.col("job_id").isNotNull() & F.col("at").isNotNull()).select("job_id", F.struct(F.unix_millis("at").alias("ms"), "seq", "status", "error").alias("e"))
        before = spark.read.schema("now long, held long").parquet(f"{path}/watermark/batch={number - 1}").first() if number else None
        newest = asked.agg(F.max("e.ms")).first()[0]
        ends = [x for x in (before and before["now"], None if newest is None else newest - 1000 * late_s) if x is not None]
        now, held = max(ends, default=None), before and before["now"]
        # As in Spark's own state, rows are late by the watermark that the batch before was run under.
        if before and before["held"] is not None:
            asked = asked.where(F.col("e.ms") > before["held"])
        known = asked.withColumn("s", F.lit(None).cast(f"struct<{STATE_FIELDS}>"))
        if before:
            old = spark.read.schema(FOLDED).parquet(f"{path}/jobs/batch={number - 1}").select("job_id", F.struct("f.status", "f.since", "f.attempts").alias("s"))
            ended = ~F.col("s.status").isin("pending", "processing") & (F.col("s.since") + 1000 * remember <= F.lit(held))
            kept = old.where((F.col("s.status") != "pending") & ~F.coalesce(ended, F.lit(False)))
            known = known.unionByName(kept, allowMissingColumns=True)
        jobs = known.groupBy("job_id").agg(F.collect_list("e").alias("es"), F.max("s").alias("s"))
        tick = now if now is not None else -(2**62)
        jobs.select("job_id", _folded(F.col("es"), F.col("s"), tick, limit, retries).alias("f")).write.mode("overwrite").parquet(f"{path}/jobs/batch={number}")
        spark.range(1).select(F.lit(now).cast("long").alias("now"), F.lit(held).cast("long").alias("held")).write.mode("overwrite").parquet(f"{path}/watermark/batch={number}")

    return write


def run_batches(stream: DataFrame, path: str, checkpoint: str, **fixed: int) -> DataFrame:
    """Runs a stream of events over all that is there by to_batches; job_id and `f` by job and batch (stored_transitions, stored_current).

    The transitions are those of run_once over job_transitions, without Python for each job. Each batch writes the states of recent jobs anew: meant for large
    batches; for many small ones there is job_transitions.
    """
    stream.writeStream.foreachBatch(to_batches(path, **fixed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(f"{FOLDED}, batch long").parquet(f"{path}/jobs")


def stored_transitions(folded: DataFrame) -> DataFrame:
    """The rows of job_transitions from those of run_batches."""
    out = folded.select("job_id", F.inline("f.out"))
    return out.select("job_id", F.timestamp_millis("ms").alias("at"), "from_status", "to_status", "accepted", "reason", "error")
