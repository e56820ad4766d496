"""Files, sinks and states: what is written twice, out of turn, late or by failed tasks."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.plans import flows
from foliant.sources import files
from foliant.streaming import sinks, states


def listed(path):
    return sorted(os.path.join(d, f)[len(str(path)) :] for d, _, names in os.walk(path) for f in names)


def test_files_of_many_tasks(spark, tmp_path):
    df = spark.range(40).repartition(5).select(F.concat(F.lit("d"), "id", F.lit(".txt")).alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("é "), F.col("id").cast("string"))).alias("content"))
    files.write_files(df, str(tmp_path / "out"))
    got = {r.name: bytes(r.content).decode() for r in files.read_files(spark, str(tmp_path / "out")).collect()}
    assert got == {f"d{i}.txt": f"é {i}" for i in range(1, 40)}
    assert sorted(x.rsplit("/")[-1] for x in listed(tmp_path / "out") if "/." not in x) == sorted(f"d{i}.txt" for i in range(40))
    assert not os.path.exists(tmp_path / "out/_temporary")
    files.write_files(df.where("name = 'd1.txt'"), str(tmp_path / "out"))
    assert len(listed(tmp_path / "out")) == 41
    files.write_files(df.where("name = 'd1.txt'"), str(tmp_path / "out"), "overwrite")
    assert len(listed(tmp_path / "out")) == 1
    files.write_files(df.limit(0), str(tmp_path / "none"))
    assert listed(tmp_path / "none") == []


@pytest.mark.parametrize("name", ["a/b", "", None, ".."])
def test_failed_tasks_leave_no_file(spark, tmp_path, name):
    """Some tasks have written all of theirs when one fails: none of it stays."""
    df = spark.createDataFrame([(f"f{i}", "x") for i in range(30)] + [(name, "x")], "name string, content string").repartition(4)
    with pytest.raises(Exception, match="is no name of a file"):
        files.write_files(df, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []


def test_repeated_attempts_leave_their_files_once(tmp_path):
    """A task that was tried three times: one attempt failed, one was lost, one is told to the driver."""
    from pyspark.sql import Row

    writer = files.FileWriter(str(tmp_path), overwrite=False).begin()
    with pytest.raises(ValueError):
        writer.write(iter([Row(name="a", content="1"), Row(name="a", content="2")]))
    writer.write(iter([Row(name="a", content="lost")]))
    writer.commit([writer.write(iter([Row(name="a", content="1")])), None])
    assert listed(tmp_path) == ["/part-00000/a"] and (tmp_path / "part-00000/a").read_text() == "1"
    late = files.FileWriter(str(tmp_path), overwrite=False).begin()
    late.write(iter([Row(name="b", content="1")]))
    late.abort([])
    with pytest.raises(OSError):  # still at work when its job has failed
        late.write(iter([Row(name="b", content="1")]))
    assert listed(tmp_path) == ["/part-00000/a"]


def test_replayed_batches_leave_the_sinks_unchanged(spark, sf, tmp_path):
    batch = flows.result_stream(spark.read.parquet(f"{sf}/documents.parquet"))
    write = sinks.to_all(str(tmp_path), flows.RESULT_SINKS, flows.RESULT)
    write(batch.where("doc_id < 50"), 0)
    write(batch.where("doc_id >= 50"), 1)
    before = sorted(flows.stored_results(spark, str(tmp_path)).collect(), key=str)
    write(batch.where("doc_id >= 50"), 1)
    assert sorted(flows.stored_results(spark, str(tmp_path)).collect(), key=str) == before and len(before) == 3 * batch.count()
    # A sink that is made anew from the stored JSON.
    sinks.regenerated(spark, str(tmp_path), flows.RESULT, "again", flows.RESULT_SINKS["csv"])
    assert sorted(spark.read.option("header", True).csv(f"{tmp_path}/again").drop("batch").collect(), key=str) == sorted(spark.read.option("header", True).csv(f"{tmp_path}/csv").drop("batch").collect(), key=str)


def test_csv_with_line_ends_and_quotes(spark, tmp_path):
    rows = [(1, "en", 'a "b"\nc, d', 3, 9), (2, None, "", 0, 0), (3, "de", None, 0, 0)]
    sinks.to_all(str(tmp_path), flows.RESULT_SINKS, flows.RESULT)(spark.createDataFrame(rows, flows.RESULT), 0)
    assert sorted(tuple(r)[:5] for r in flows.stored_results(spark, str(tmp_path)).where("sink = 'csv'").collect()) == [(*x[:2], x[2] or None, *x[3:]) for x in rows]
    assert sorted(tuple(r)[:5] for r in flows.stored_results(spark, str(tmp_path)).where("sink = 'json'").collect()) == rows


def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


def stream_of(spark, tmp_path, batches):
    """A file for each batch, taken one at a time in the order of their times."""
    folder = tmp_path / "events"
    folder.mkdir()
    schema = "job_id long, at timestamp, seq int, status string, error string"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(j, at(s), q, status, error) for j, s, q, status, error in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        file = next((tmp_path / f"b{i}").glob("part-*"))
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)
        file.rename(folder / f"{i}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def told(rows):
    return sorted((r.job_id, (r.at - at(0)).total_seconds(), r.from_status, r.to_status, r.accepted, r.reason, r.error) for r in rows)


def test_job_states(spark, tmp_path):
    hour = 3600
    stream = stream_of(spark, tmp_path, [
        [(1, 10, 1, "processing", None), (2, 10, 1, "processing", None), (3, 10, 1, "completed", None), (4, 10, 1, "processing", None), (4, 20, 2, "failed", "bad page"), (6, 10, 1, "processing", None)],
        # 1 goes on in a later batch; 2 is told too late, after its limit; 4 begins again, and is told of what was before.
        [(1, 300, 2, "completed", None), (2, 900, 2, "completed", None), (4, 30, 3, "processing", None), (4, 25, 2, "cancelled", None), (1, 301, 3, "failed", "again")],
        # The watermark passes 6's limit, of which no event tells; and a job that is not heard of before.
        [(5, 2 * hour, 1, "cancelled", None)],
        [(5, 2 * hour + 5, 3, "failed", None)],
        # Behind the watermark of the batches before: dropped.
        [(6, 40, 2, "completed", None), (5, 2 * hour + 9, 2, "processing", None)],
    ])
    out = states.run_once(states.job_transitions(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    limit = states.TIMED_OUT
    assert told(out.collect()) == sorted([
        (1, 10, "pending", "processing", True, None, None), (1, 300, "processing", "completed", True, None, None), (1, 301, "completed", "failed", False, "not allowed", None),
        (2, 10, "pending", "processing", True, None, None), (2, 610, "processing", "failed", True, None, limit), (2, 900, "failed", "completed", False, "not allowed", None),
        (3, 10, "pending", "completed", False, "not allowed", None),
        (4, 10, "pending", "processing", True, None, None), (4, 20, "processing", "failed", True, None, "bad page"), (4, 25, "failed", "cancelled", False, "not allowed", None), (4, 30, "failed", "processing", True, None, None), (4, 630, "processing", "failed", True, None, limit),
        (5, 2 * hour, "pending", "cancelled", True, None, None), (5, 2 * hour + 5, "cancelled", "failed", False, "not allowed", None), (5, 2 * hour + 9, "cancelled", "processing", False, "not allowed", None),
        (6, 10, "pending", "processing", True, None, None), (6, 610, "processing", "failed", True, None, limit),
    ])
    now = {r.job_id: (r.status, r.attempts, r.error) for r in states.current(out).collect()}
    assert now == {1: ("completed", 1, None), 2: ("failed", 1, limit), 4: ("failed", 2, limit), 5: ("cancelled", 0, None), 6: ("failed", 1, limit)}


def test_job_states_late_retries_and_expiry(spark, tmp_path):
    day = 86_400
    fails = [(7, 10 * i + s, 2 * i + s, "processing" if s == 0 else "failed", None if s == 0 else f"e{i}") for i in range(5) for s in (0, 1)]
    stream = stream_of(spark, tmp_path, [
        [(1, 100, 1, "processing", None), *fails],
        [(1, 50, 2, "cancelled", None), (1, 200, 3, "completed", None)],
        # Two days on, a job that ended is forgotten: its number may begin anew.
        [(2, 2 * day, 1, "cancelled", None)],
        [(2, 2 * day + 1, 1, "processing", None), (1, 2 * day + 10, 1, "processing", None), (1, 2 * day + 20, 2, "completed", None)],
    ])
    out = told(states.run_once(states.job_transitions(stream), str(tmp_path / "out"), str(tmp_path / "check")).collect())
    assert [x[1:6] for x in out if x[0] == 1] == [
        (50, "processing", "cancelled", False, "late"), (100, "pending", "processing", True, None), (200, "processing", "completed", True, None),
        (2 * day + 10, "pending", "processing", True, None), (2 * day + 20, "processing", "completed", True, None),
    ]
    seven = [x[1:] for x in out if x[0] == 7]
    assert [x[3] for x in seven] == [True] * 8 + [False, False] and {x[4] for x in seven[8:]} == {"no retries left", "not allowed"}
