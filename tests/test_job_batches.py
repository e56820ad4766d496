"""Jobs folded by batches, held against the state machine that takes them one by one."""

from pyspark.sql import functions as F
from test_flows import stream_of, told

from foliant.sources import tables
from foliant.streaming import states

HOUR, DAY = 3600, 86_400


def both(stream, path):
    one = states.run_once(states.job_transitions(stream), str(path / "one"), str(path / "one-check"))
    return told(one.collect()), told(states.stored_transitions(states.run_batches(stream, str(path / "all"), str(path / "all-check"))).collect())


def test_batches_as_one_by_one(spark, tmp_path):
    fails = [(7, 10 * i + s, 2 * i + s, "processing" if s == 0 else "failed", f"e{i}") for i in range(5) for s in (0, 1)]
    stream = stream_of(spark, tmp_path, [
        [(1, 10, 1, "processing", None), (2, 10, 1, "processing", None), (3, 10, 1, "completed", None), (4, 10, 1, "processing", None), (4, 20, 2, "failed", "bad page"), (6, 10, 1, "processing", None), *fails],
        [(1, 300, 2, "completed", None), (2, 900, 2, "completed", None), (4, 30, 3, "processing", None), (4, 25, 2, "cancelled", None), (1, 301, 3, "failed", "again"), (8, 5, 1, None, None)],
        [(5, 2 * HOUR, 1, "cancelled", None), (None, 2 * HOUR, 1, "cancelled", None)],
        [(5, 2 * HOUR + 5, 3, "failed", None), (4, 50, 9, "processing", None)],
        [(6, 40, 2, "completed", None), (5, 2 * HOUR + 9, 2, "processing", None)],
        [(9, 3 * DAY, 1, "processing", None)],
        [(1, 3 * DAY + 10, 1, "processing", None), (5, 3 * DAY, 1, "processing", None), (5, 3 * DAY + 700, 2, "completed", None)],
    ])
    one, batched = both(stream, tmp_path)
    assert one == batched and len(one) > 25


def test_batch_that_is_run_again_counts_once(spark, tmp_path):
    rows = lambda *at: spark.createDataFrame([(1, s, s, status, None) for s, status in at], "job_id long, s long, seq int, status string, error string").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s")))
    write = states.to_batches(str(tmp_path))
    write(rows((1, "processing")), 0)
    for _ in range(2):
        write(rows((2, "failed"), (3, "processing")), 1)
    got = states.stored_transitions(spark.read.schema(f"{states.FOLDED}, batch long").parquet(f"{tmp_path}/jobs"))
    assert [x[2:5] for x in told(got.collect())] == [("pending", "processing", True), ("processing", "failed", True), ("failed", "processing", True)]


def test_many_events_of_one_job(spark, tmp_path):
    """More than one part of a fold, with retries that run out, as the machine has them."""
    stream = stream_of(spark, tmp_path, [[(1, i, i, ("processing", "failed", "completed")[i % 5 % 3], f"e{i}") for i in range(400)]])
    one, batched = both(stream, tmp_path)
    assert one == batched and len(one) == 400


def test_events_of_the_tables(spark, sf, tmp_path):
    events = tables.job_events(spark, sf)
    events.write.parquet(str(tmp_path / "events"))
    one, batched = both(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), tmp_path)
    assert one == batched and one
