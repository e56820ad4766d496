"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import digest, ranked, saved

#: Group ends that the driver holds at most in one refinement.
ENDS = 1 << 15


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


class Ends:
    """Known group ends as running totals; between two of them there may be more, unless the later one is `exact`."""

    def __init__(self, total: int):
        self.total = total
        self.at: dict[int, tuple[int, bool]] = {}

    def add(self, rows: list[tuple[int, int, bool]]) -> None:
        for end, count, exact in rows:
            self.at[end] = (count, exact or self.at.get(end, (0, False))[1])
        self.sorted = sorted(self.at)

    def reach(self, start: int, capacity: int, optimistic: bool) -> int:
        """The farthest end of a shard that begins at start; optimistic: unknown ends count as if they were anywhere."""
        most = start + capacity
        i = bisect_right(self.sorted, most)
        last = self.sorted[i - 1] if i and self.sorted[i - 1] > start else start
        if optimistic and i < len(self.sorted) and most > last and not self.at[self.sorted[i]][1]:
            return most
        return last

    def cuts(self, capacity: int, shards: int, optimistic: bool = False) -> list[int] | None:
        """Greedy cuts under a capacity, or None if more than `shards` shards are needed."""
        found, start = [], 0
        while start < self.total:
            end = self.reach(start, capacity, optimistic)
            if end <= start or len(found) == shards:
                return None
            found.append(end)
            start = end
        return found

    def smallest(self, shards: int, optimistic: bool, low: int, high: int) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, optimistic) is None:
                low = mid + 1
            else:
                high = mid
        return low


def _latest_starts(ends: Ends, capacity: int, shards: int) -> list[int]:
    """For each shard, the smallest end that leaves what follows feasible: greedy from the back."""
    order = [0, *ends.sorted]
    need = [ends.total]
    for _ in range(shards - 1):
        least = max(0, need[-1] - capacity)
        i = bisect_right(order, least - 1)
        need.append(order[i])
    return need[::-1]


def balanced_cuts(ends: Ends, capacity: int, shards: int) -> list[int]:
    """Cuts that keep to the smallest feasible capacity, each as near as possible to an equal share of what is left."""
    latest, start, found = _latest_starts(ends, capacity, shards), 0, []
    order = [0, *ends.sorted]
    for k in range(shards - 1):
        low, high = max(latest[k], start), ends.reach(start, capacity, False)
        aim = start + (ends.total - start) / (shards - k)
        i = bisect_right(order, aim)
        near = [x for x in order[max(0, i - 1) : i + 1] if low <= x <= high] or [low if aim < low else high]
        start = min(near, key=lambda x: (abs(x - aim), x))
        found.append(start)
    return found


def shard(df: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text", ends_held: int = ENDS, scope: str = "") -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, shard, slot.

    Groups are the rows of equal text (null texts are one group), in the order of the text's SHA-256; a group never
    parts. Size is the text's UTF-8 bytes plus 16. The smallest feasible capacity is found by binary search, each
    step checked greedily over the ordered group sizes, and the cuts keep to it. Running totals come from range
    partitions; the driver holds at most `ends_held` group ends at a time, first a coarse set over the whole table, then
    finer sets where the cuts of the remaining capacities can fall, until the smallest capacity is certain.
    slot counts the rows of a shard from 0, in the order of (group, doc_id); text_crc32 is that of the UTF-8 bytes, of none
    for null. Null and repeated doc_ids are rows like any other. An empty table gives no rows; shards may stay empty if
    there are too few groups. Columns of df besides doc_id and text have no part in it.
    """
    rows, cuts, counts, _ = _planned(df, shards, doc_id, text, ends_held, scope)
    starts = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<long>")
    before = F.array(*(F.lit(counts[c]).cast("long") for c in [0, *cuts]))
    out = rows.select("doc_id", "size", "text_crc32", "rn", F.size(F.filter(starts, lambda c: c < F.col("upto_bytes"))).alias("shard"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("rn") - 1 - F.element_at(before, F.col("shard") + 1)).alias("slot"))


def assigned(df: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text", ends_held: int = ENDS, scope: str = "") -> DataFrame:
    """The rows of df with `shard`, as shard() has it; a column of that name is replaced, all others stay.

    Shards are ranges of the texts' SHA-256, so that each row finds its own by the last groups of the shards: texts
    aren't shuffled.
    """
    _, cuts, _, ends = _planned(df, shards, doc_id, text, ends_held, scope)
    last = [r["_group"] for r in ends.where(F.col("upto_bytes").isin(cuts)).select("_group").orderBy("_group").collect()] if cuts else []
    bounds = F.array(*(F.lit(bytes(g)) for g in last)) if last else F.array().cast("array<binary>")
    own = F.size(F.filter(bounds, lambda g: g < _group(F.col(text))))
    return df.select(*(df[c] for c in df.columns if c != "shard"), own.alias("shard"))


def _group(text: Column) -> Column:
    return F.coalesce(digest(text), F.lit(b""))


def _planned(df: DataFrame, shards: int, doc_id: str, text: str, ends_held: int, scope: str) -> tuple[DataFrame, list[int], dict[int, int], DataFrame]:
    """The rows in order with running totals, the totals at which shards end, the rows up to each, and the groups' ends."""
    base = df.select(F.col(doc_id).alias("doc_id"), text_bytes(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), _group(F.col(text)).alias("_group"))
    rows, ranges = ranked(base, [F.col("_group"), F.col("doc_id"), F.col("size")], {"bytes": "size"}, "shard-rows", scope)
    total = sum(t["bytes"] or 0 for t in ranges)
    if not total:
        return rows, [], {0: 0}, rows.select("_group", "upto_bytes")
    w = Window.partitionBy("pid").orderBy("_key0", "_key1", "_key2", "rn")
    last = rows.select("pid", "_group", "upto_bytes", "rn", F.lead("_group").over(w).alias("_next"))
    last = saved(last.where(F.col("_next").isNull() | (F.col("_next") != F.col("_group"))), "shard-ends", scope)
    edges = last.where(F.col("_next").isNull()).select("pid", "_group", "upto_bytes").orderBy("pid").collect()
    firsts = {r["pid"]: r["g"] for r in last.groupBy("pid").agg(F.min("_group").alias("g")).collect()}
    # The end of a range is no group's end if the next range begins with the same group.
    parted = [r["upto_bytes"] for r, n in zip(edges, edges[1:], strict=False) if firsts[n["pid"]] == r["_group"]]
    ends_at = last.select("upto_bytes", "rn")
    if parted:
        ends_at = ends_at.where(~F.col("upto_bytes").isin(parted))

    ends, spans = Ends(total), [(0, total)]
    low, high, step = 1, total, 2 * total
    while True:
        # At least twice as fine as before: with steps of 1 byte, every end is known.
        step = max(1, min(step // 2, sum(b - a for a, b in spans) // max(ends_held - 2 * len(spans), 4 * len(spans))))
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | F.col("upto_bytes").between(a, b)
        found = ends_at.where(inside).groupBy(F.floor((F.col("upto_bytes") - 1) / F.lit(step)).alias("part")).agg(
            F.max("upto_bytes").alias("end"), F.max("rn").alias("rows"), F.count("*").alias("n")
        ).collect()
        ends.add([(r["end"], r["rows"], False) for r in found])
        _mark_exact(ends, found, step, spans)
        low, high = ends.smallest(shards, True, low, high), ends.smallest(shards, False, low, high)
        if low == high:
            break
        spans = _doubtful(ends, low, high, shards)
    cuts = balanced_cuts(ends, high, shards)
    return rows, cuts, {0: 0, **{e: n for e, (n, _) in ends.at.items()}}, last


def _mark_exact(ends: Ends, found: list, step: int, spans: list[tuple[int, int]]) -> None:
    """An end is exact if no unknown end can lie between the end before it and itself.

    A part of the range that holds no end isn't in found; so only the part of the end itself can hide another one.
    """
    for r in found:
        i, j = bisect_right(ends.sorted, r["part"] * step), bisect_right(ends.sorted, (r["part"] + 1) * step)
        known = [(e, a) for e in ends.sorted[i:j] for a, b in spans if a <= e <= b]
        if len(known) == r["n"]:
            for e, a in known:
                if e > a:  # at the start of a span, what lies before it wasn't looked at
                    ends.at[e] = (ends.at[e][0], True)


def _doubtful(ends: Ends, low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """Where greedy cuts can fall for capacities from low to high, widened to the known ends around."""
    spans: list[tuple[int, int]] = []
    near = far = 0
    for _ in range(shards):
        near, far = ends.reach(near, low, False), ends.reach(far, high, True)
        i, j = bisect_right(ends.sorted, near) - 1, bisect_right(ends.sorted, far)
        a, b = ends.sorted[i] if i >= 0 else 0, ends.sorted[j] if j < len(ends.sorted) else ends.total
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        elif a < b:
            spans.append((a, b))
    return spans


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
