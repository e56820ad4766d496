"""Analytics over jobs, results and requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import scalars


def job_statistics(jobs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """By status and day of creation, for the days before as_of: jobs, mean seconds, mean size."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    recent = jobs.where(F.col("created_at") >= since)
    return recent.groupBy("status", F.date_trunc("day", "created_at").alias("day")).agg(F.count("*").alias("job_count"), F.avg(seconds).alias("avg_seconds"), F.avg("document_size").alias("avg_size"))


def processing_performance(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """By profile and mode, for completed jobs. total_jobs counts joined rows, distinct_jobs the jobs.

    Results are summed by job before the join, which then has at most one row per job on either side.
    """
    by_job = results.groupBy("job_id").agg(
        F.count("*").alias("n"), F.sum("confidence_avg").alias("c"), F.count("confidence_avg").alias("nc"), F.sum("processing_time_ms").alias("t"), F.count("processing_time_ms").alias("nt"), F.sum("word_count").alias("w"), F.sum("tokens_extracted").alias("k")
    )
    joined = jobs.where("status = 'completed'").select("job_id", "processing_profile", "processing_mode").join(by_job, "job_id", "left")
    return joined.groupBy("processing_profile", "processing_mode").agg(
        F.sum(F.coalesce("n", F.lit(1))).alias("total_jobs"), F.count("*").alias("distinct_jobs"), (F.sum("c") / F.sum("nc")).alias("avg_confidence"), (F.sum("t") / F.sum("nt")).alias("avg_time_ms"),
        F.sum("w").alias("total_words"), F.sum("k").alias("total_tokens"),
    )


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a list; order must be without ties."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is from 1 to 100")
    return df.orderBy(*order).offset(offset).limit(limit)


def progress(jobs: DataFrame, now: str) -> DataFrame:
    """Each job's message and seconds to go."""
    at = F.lit(now).cast("timestamp")
    eta = scalars.eta_seconds(F.col("status"), F.col("progress"), F.col("started_at"), at)
    return jobs.select("job_id", "status", "progress", eta.alias("eta_seconds"), scalars.status_message(F.col("status"), F.col("progress")).alias("message"))


def latest(df: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.struct(at, tie)).alias(value), F.max(at).alias(at))


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint").agg(F.count("*").alias("n"))


def duration_buckets(requests: DataFrame, bounds: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """Cumulative counts of durations up to each bound, by endpoint; one aggregation, then a row per bound."""
    sums = requests.groupBy("endpoint").agg(F.count("*").alias("total"), *(F.count_if(F.col("duration_s") <= b).alias(f"_{i}") for i, b in enumerate(bounds)))
    rows = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)))
    return sums.select("endpoint", "total", F.inline(rows))


def request_metrics(requests: DataFrame, bounds: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)) -> DataFrame:
    """By method, endpoint and status_code the requests, and by method and endpoint their time and cumulative counts up to each bound.

    The counter and the histogram are made from one aggregation: the second sums the rows of the first.
    """
    each = requests.groupBy("method", "endpoint", "status_code").agg(F.count("*").alias("requests"), F.sum("duration_s").alias("_s"), *(F.count_if(F.col("duration_s") <= b).alias(f"_{i}") for i, b in enumerate(bounds)))
    w = Window.partitionBy("method", "endpoint")
    cumulative = F.map_from_arrays(F.array(*(F.lit(str(b)) for b in bounds)), F.array(*(F.sum(f"_{i}").over(w) for i in range(len(bounds)))))
    return each.select("method", "endpoint", "status_code", "requests", F.sum("requests").over(w).alias("total"), F.sum("_s").over(w).alias("seconds"), cumulative.alias("upto"))


def job_rates(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """By job with results: seconds, and pages, words and KB a second; 0 without time. Results are summed before the join."""
    sums = results.groupBy("job_id").agg(F.count("*").alias("pages"), F.sum("word_count").alias("words"), (F.sum("processing_time_ms") / 1000).alias("seconds"))
    both, s = jobs.select("job_id", "document_size").join(sums, "job_id"), F.col("seconds")
    return both.select("job_id", "seconds", *(scalars.throughput(amount, s).alias(name) for amount, name in ((F.col("pages"), "pages_per_s"), (F.col("words"), "words_per_s"), (F.col("document_size") / 1024, "kb_per_s"))))


def checkpoints(models: DataFrame, model_name: str | None = None, is_active: bool | None = None) -> DataFrame:
    """Checkpoints of a model, or those that are active or not; a filter that isn't given lets all through. The latest first."""
    if model_name:
        models = models.where(F.col("model_name") == model_name)
    if is_active is not None:
        models = models.where(F.col("is_active") == is_active)
    return models.orderBy(F.desc("created_at"), "checkpoint_id")


def access(requests: DataFrame, users: DataFrame, role: str) -> DataFrame:
    """Each request with the status that a role's guard answers: 401 without a known user, 403 without the role, else 200."""
    known = users.select(F.col("user_id").alias("client"), "roles", F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), 401).when(F.coalesce(F.array_contains("roles", role), F.lit(False)), 200).otherwise(403)
    return requests.join(known, "client", "left").select("request_id", "client", status.alias("status_code"))


def api_metrics(requests: DataFrame, failure: Column) -> DataFrame:
    """Success rate and mean time, with denominators of 1 at least."""
    ok, n = F.count_if(~failure), F.count("*")
    return requests.agg(n.alias("requests"), (ok / F.greatest(n, F.lit(1))).alias("success_rate"), (F.coalesce(F.sum("duration_s"), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("avg_time_s"))


def offered_load(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests of the client in the window that ends with each request, whether admitted or not."""
    w = Window.partitionBy("client").orderBy(F.unix_timestamp("at")).rangeBetween(-seconds + 1, 0)
    return requests.select("request_id", "client", F.count("*").over(w).alias("load"))


def admitted(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Sliding-window rate limit: a request is admitted if fewer than `limit` admitted ones of the client are younger
    than `seconds`; rejected ones don't count.

    A client's requests pass in order through one state of at most `limit` times, so clients are sorted and cut into
    partitions, and no client's requests are held together in memory.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept, begun = None, [], False
        for x in batches:
            out = []
            for c, at in zip(x["client"], x["s"], strict=True):
                if not begun or c != client:
                    client, kept, begun = c, [], True
                kept = [t for t in kept if at - t < seconds]
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(at)
            yield pd.DataFrame({"request_id": x["request_id"], "client": x["client"], "admitted": out})

    ordered = requests.select("request_id", "client", F.unix_timestamp("at").alias("s")).repartition("client").sortWithinPartitions("client", "s", "request_id")
    return ordered.mapInPandas(work, "request_id long, client long, admitted boolean")


def retention(files: DataFrame, as_of: str, days: int) -> DataFrame:
    """Files to delete (strictly older), and their bytes."""
    before = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    old = F.col("modified_at") < before
    return files.agg(F.count_if(old).alias("files_deleted"), F.coalesce(F.sum(F.when(old, F.col("bytes"))), F.lit(0)).cast("double").alias("bytes_freed"), F.count_if(~old).alias("files_kept"))


def cache_misses(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a result of equal content and parameters; missing parameters equal missing ones."""
    same = [requests[k].eqNullSafe(results[k]) for k in keys]
    return requests.join(results, same, "left_anti")


def cache_hits(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    same = [requests[k].eqNullSafe(results[k]) for k in keys]
    return requests.join(results, same, "left_semi")


def activated(models: DataFrame, model: str, chosen: str) -> DataFrame:
    """Of a model's checkpoints only the chosen one is active."""
    return models.withColumn("is_active", F.when(F.col("model_name") == model, F.col("checkpoint_id") == chosen).otherwise(F.col("is_active")))


def batch_totals(uploads: DataFrame, most: int = 10) -> DataFrame:
    """By batch: files, accepted, refused; a batch of more than `most` is refused whole."""
    n = F.count("*")
    ok = F.when(n > most, F.lit(0)).otherwise(F.count_if(F.col("reason").isNull()))
    return uploads.groupBy("batch_id").agg(n.alias("total"), ok.alias("accepted"), (n - ok).alias("refused"))
