"""Mixing sources to target weights, by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, ranked, saved

#: Words: runs of what isn't white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the hash range by which each source's fractional repetition is located.
SLICES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, name: str = "fill", scope: str = "") -> DataFrame:
    """Adds `target` to (weight double, cap double, ...): shares of total by weight, none above its cap.

    Sources above their caps are clamped and the excess is shared again by weight, until none is above. Each
    round is one aggregate over the sources; no more rounds than sources follow. If the caps add up to less
    than total, each source gets its cap.
    """
    clamped = F.lit(False)
    while True:
        row = sources.select(clamped.alias("full"), "weight", "cap").agg(
            F.sum(F.when(F.col("full"), F.col("cap"))).alias("caps"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("free"), F.count_if(F.col("full")).alias("n")
        ).first()
        if not row["free"]:
            return sources.withColumn("target", F.col("cap"))
        level = max(0.0, total - (row["caps"] or 0.0)) / row["free"]
        clamped = F.col("weight") * F.lit(level) > F.col("cap")
        if sources.where(clamped).count() == row["n"]:
            return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap")))


def mix(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2),
    weight_of: Callable[[Column], Column] | None = None, budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, scope: str = "",
) -> DataFrame:
    """Adds to each row `size`, `source_size`, `target` (its source's) and `repetitions`.

    Sources, in the order of code points with null last, get the weights in turn (or weight_of(source)), and share
    budget times the words of all rows by capped water-filling. A source of which the mix takes e epochs takes each
    row floor(e) times, and once more the rows with the smallest seeded hashes of (doc_id, size), up to the row that
    brings the source nearest its target. Rows that agree in both are taken alike. Null texts have size 0; null is a
    source of its own; columns of the names that are added are replaced. An empty table gives an empty one.
    """
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id), word_count(F.col(text)))
    narrow = saved(df.select(F.col(source).alias("s"), word_count(F.col(text)).alias("size"), hashed.alias("h")), "mix-sizes", scope)
    slot = F.shiftrightunsigned("h", 64 - (SLICES.bit_length() - 1))
    slices = saved(narrow.groupBy("s", slot.alias("slice")).agg(F.sum("size").alias("words")), "mix-slices", scope)
    sources = saved(slices.groupBy("s").agg(F.sum("words").alias("source_size")), "mix-sources", scope)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    if weight_of is None:
        cycle = F.array(*(F.lit(float(w)) for w in weights))
        order, _ = ranked(sources, [F.col("s").isNull(), F.col("s")], {}, "mix-order", scope)
        weighed = order.select("s", "source_size", F.element_at(cycle, ((F.col("rn") - 1) % len(weights) + 1).cast("int")).alias("weight"))
    else:
        weighed = sources.withColumn("weight", weight_of(F.col("s")).cast("double"))
    weighed = saved(weighed.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "mix-weights", scope)
    plan = water_fill(weighed, budget * total).withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = saved(plan.withColumn("whole", F.floor("epochs")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan", scope)

    # The hash up to which a source's rows are taken once more: first its slice, then the row within that slice.
    upto = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    reached = slices.withColumn("upto", F.sum("words").over(upto)).join(_same(plan, "s", "rest"), F.col("s").eqNullSafe(F.col("_s")))
    edge = reached.where("upto > rest").groupBy("s").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"), "rest"), "slice").alias("e"))
    edge = saved(edge.select(F.col("s").alias("_s"), F.col("e.slice").alias("slice"), F.col("e.before").alias("before"), F.col("e.rest").alias("rest")), "mix-edges", scope)
    near = narrow.withColumn("slice", slot).join(lookup(edge), (F.col("s").eqNullSafe(F.col("_s"))) & (edge["slice"] == F.shiftrightunsigned("h", 64 - (SLICES.bit_length() - 1))))
    ties = near.groupBy("s", "h", "before", "rest").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    upto = Window.partitionBy("s").orderBy(_unsigned("h")).rowsBetween(Window.unboundedPreceding, 0)
    over = ties.withColumn("upto", F.col("before") + F.sum("size").over(upto)).where(F.col("upto") > F.col("rest"))
    last = over.groupBy("s").agg(F.min_by(F.struct("h", "rows", "size", (F.col("rest") - F.col("upto") + F.col("size")).alias("open")), _unsigned("h")).alias("e"))
    # Rows before the hash `last` are taken once more, and `more` of the rows with it.
    more = F.least(F.col("e.rows"), F.floor(F.col("e.open") * F.col("e.rows") / F.col("e.size") + 0.5))
    limits = last.select(F.col("s").alias("_s"), F.col("e.h").alias("last"), F.col("e.rows").alias("ties"), more.alias("more"))
    plan = plan.join(limits, F.col("s").eqNullSafe(F.col("_s")), "left").select(F.col("s").alias("_s"), "source_size", "target", "whole", "rest", "last", "ties", "more")
    plan = saved(plan, "mix-limits", scope)
    added = ("size", "source_size", "target", "repetitions")
    kept = [c for c in df.columns if c not in added]
    rows = df.select(*(df[c] for c in kept), hashed.alias("__h"), word_count(F.col(text)).alias("__size"), F.col(source).alias("__of"))
    known = plan.select(*(F.col(c).alias(f"__{c}") for c in ("_s", "source_size", "target", "whole", "rest", "last", "ties", "more")))
    joined = rows.join(lookup(known), F.col("__of").eqNullSafe(F.col("___s")), "left")
    split = F.coalesce((F.col("__h") == F.col("__last")) & F.col("__more").between(1, F.col("__ties") - 1), F.lit(False))
    at_last = (F.col("__h") == F.col("__last")) & (F.col("__more") > 0)
    once_more = F.when(F.col("__last").isNull(), F.col("__rest") > 0).otherwise((_unsigned("__h") < _unsigned("__last")) | at_last)

    def finished(part: DataFrame, taken: Column) -> DataFrame:
        return part.select(
            *kept, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
            (F.col("__whole") + taken.cast("long")).cast("int").alias("repetitions"),
        )

    if plan.where("more > 0 and more < ties").isEmpty():
        return finished(joined, once_more)
    # Rows that agree in doc_id and text where a source's mix ends: numbered over range partitions of their own.
    tied = saved(joined.where(split).withColumn("__row", F.monotonically_increasing_id()), "mix-tied", scope)
    numbered, _ = ranked(tied.select("__h", "__row"), [F.col("__h"), F.col("__row")], {}, "mix-ranks", scope)
    firsts = saved(numbered.groupBy("__h").agg(F.min("rn").alias("__from")), "mix-firsts", scope)
    ranks = numbered.select(F.col("__row").alias("__at"), "rn", F.col("__h").alias("__g")).join(lookup(firsts), F.col("__g") == F.col("__h")).select("__at", "rn", "__from")
    some = tied.join(ranks, F.col("__row") == F.col("__at"))
    return finished(joined.where(~split), once_more).unionByName(finished(some, F.col("rn") - F.col("__from") < F.col("__more")))


def _unsigned(h: str | Column) -> Column:
    """Longs in the order of their bits read as unsigned numbers."""
    return (F.col(h) if isinstance(h, str) else h).bitwiseXOR(F.lit(-(2**63)))


def _same(plan: DataFrame, key: str, *columns: str) -> DataFrame:
    return lookup(plan.select(F.col(key).alias(f"_{key}"), *columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"), "repetitions")
