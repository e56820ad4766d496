"""Confidence statistics, quality buckets and summaries over tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import scalars
from foliant.sources.storage import saved


def stats(df: DataFrame, *by: str, value: str = "confidence") -> DataFrame:
    """n, mean, median, population deviation, least and most."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")
    )


#: Buckets of a histogram.
BINS = 1024


def _magnitude(x: Column) -> Column:
    """Numbers in their order by sign and power of two, so that a first histogram finds the magnitude."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


def _half(x: Column) -> Column:
    """Halves, since a difference may be beyond the largest number; that of the least numbers is lost with them."""
    return x / 2


def medians(df: DataFrame, *by: str, value: str) -> DataFrame:
    """by, median: exact medians of any number of values a key, by histograms that are refined until one value is left.

    Equal values are counted first, within tasks before the shuffle. Of each key the two middle ranks are sought: each round
    counts what lies in each of BINS parts of the range that is left, with the least and the most of each part, and goes on in
    the part that holds the rank. No task has to hold a key's values, and the ends of a range are values, so that each round
    parts them. Null, NaN and infinite values take no part; a key without others has no row. Null keys are a key.
    """
    v = F.col("_v")
    values = df.select(*by, F.col(value).cast("double").alias("_v")).where((F.abs(v) < float("inf")) & ~F.isnan(v))
    counted = saved(values.groupBy(*by, "_v").agg(F.count("*").alias("_n")), "median-values")
    size = F.sum("_n")
    ranks = F.array(F.floor((size - 1) / 2), F.floor(size / 2))
    state = counted.groupBy(*by).agg(ranks.alias("ranks"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = saved(state.select(*by, F.posexplode("ranks").alias("which", "rank"), "lo", "hi"), "median-ranks")
    found, scale = state.where("lo = hi"), _magnitude
    while not (left := state.where("lo < hi")).isEmpty():
        same = [counted[k].eqNullSafe(left[k]) for k in by] or [F.lit(True)]
        met = counted.join(left, same + [v.between(F.col("lo"), F.col("hi"))]).select(*(left[k] for k in by), "which", "rank", "lo", "hi", "_v", "_n")
        lo, x, hi = (scale(c) for c in (F.col("lo"), v, F.col("hi")))
        share, scale = F.try_divide(x - lo, hi - lo), _half
        at = F.least(F.floor(F.coalesce(share, (v > F.col("lo")).cast("double")) * BINS), F.lit(BINS - 1))
        parts = met.groupBy(*by, "which", "rank", at.alias("part")).agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by, "which").orderBy("part"))
        holds = parts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        state = saved(holds.select(*by, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi"), "median-ranks")
        found = found.unionByName(state.where("lo = hi"))
    return found.groupBy(*by).agg((F.min("lo") / 2 + F.max("lo") / 2).alias("median"))


def stats_of_large_groups(df: DataFrame, *by: str, value: str) -> DataFrame:
    """What stats gives, for keys that may hold any share of the rows."""
    v = F.col(value)
    sums = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")).alias("s")
    found = medians(df, *by, value=value).alias("m")
    out = sums.join(found, [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in by], "left")
    return out.select(*(F.col(f"s.{k}") for k in by), "n", "mean", "median", "std", "least", "most")


def buckets(df: DataFrame, *by: str) -> DataFrame:
    """Tokens by quality, a row for each bucket that occurs."""
    return df.groupBy(*by, scalars.quality(F.col("confidence")).alias("quality")).agg(F.count("*").alias("n"))


def bucket_shares(df: DataFrame) -> DataFrame:
    """Counts and percentages, one pass."""
    q, n = scalars.quality(F.col("confidence")), F.greatest(F.count("confidence"), F.lit(1))
    out = []
    for name in ("High", "Medium", "Low"):
        c = F.count_if(q == name)
        out += [c.alias(f"{name.lower()}_count"), (c / n * 100).alias(f"{name.lower()}_pct")]
    return df.agg(*out)


def histogram(df: DataFrame, value: Column, bins: int, least: float, most: float) -> DataFrame:
    """Bins of equal width from least to most, both included."""
    at = F.least(F.floor((value - least) / (most - least) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def document_summary(documents: DataFrame, tokens: DataFrame) -> DataFrame:
    """By document: sizes of the text, and the statistics and buckets of its tokens (0 for a document without any)."""
    q, c = scalars.quality(F.col("confidence")), F.col("confidence")
    sizes = documents.select("doc_id", scalars.word_count(F.col("text")).cast("long").alias("word_count"), F.length("text").cast("long").alias("char_count"), F.size(F.split("text", "\n")).cast("long").alias("page_count"))
    found = tokens.groupBy("doc_id").agg(
        F.avg(c).alias("avg"), F.median(c).alias("median"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        *(F.count_if(q == name).alias(name.lower()) for name in ("High", "Medium", "Low")),
    )
    return sizes.join(found, "doc_id", "left").select(
        "doc_id", "page_count", "word_count", "char_count", *(F.coalesce(x, F.lit(0.0)).alias(f"{x}_confidence") for x in ("avg", "median", "std", "min", "max")),
        *(F.coalesce(x, F.lit(0)).cast("long").alias(f"{x}_count") for x in ("high", "medium", "low")),
    )


def macro_and_micro(tokens: DataFrame) -> DataFrame:
    """The mean of the documents' means, and the mean over all tokens, from one aggregation by document."""
    by = tokens.groupBy("doc_id").agg(F.avg("confidence").alias("mean"), F.sum("confidence").alias("total"), F.count("confidence").alias("n"))
    return by.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.avg("mean").alias("macro"), (F.sum("total") / F.sum("n")).alias("micro"))


def or_default(value: Column, default: float) -> Column:
    """What an average over nothing counts as: 0 for documents, 1 for pages with native text."""
    return F.coalesce(value, F.lit(default))


def job_confidence(average: Column) -> Column:
    """0 counts as missing, and what is missing as 0.9."""
    return F.coalesce(F.nullif(average, F.lit(0.0)), F.lit(0.9))
