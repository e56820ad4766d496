"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lookup, saved
from .jaccard import Texts, text_id

SEED = 42
#: Fingerprints in a cell of the grid up to which its pairs are compared one by one.
CELL = 256
#: Bits 0, 2, 4, ...: the low bit of each 2-bit segment.
LOW = 0x5555555555555555
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def shingle_digests(text: str | None, k: int) -> list[bytes]:
    """XXH64 (seed 42, big-endian) of each run of k words, A-Z lower-cased; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    if len(words) <= k:
        return [xxhash.xxh64_digest(line, SEED)]
    end = np.cumsum(size + 1) - 1
    return [xxhash.xxh64_digest(line[a:b], SEED) for a, b in zip((end - size).tolist(), end[k - 1 :].tolist(), strict=False)]


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; signed 64 bits."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprint_column(text: str, shingle: int) -> Column:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(np.frombuffer(b"".join(shingle_digests(x, shingle)), ">u8")) for x in texts], dtype="int64")

    return simhash(F.col(text))


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 segments of 2 bits, in unary: 0 is 00, 1 is 01, 2 is 11.

    The Manhattan distance of two vectors of counts is the number of bits in which their codes differ, and never more
    than the number of bits in which the fingerprints differ.
    """
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(LOW)), 1))


def _cells(fps: DataFrame, probes: bool) -> DataFrame:
    """Rows (half, cell, fp). With probes: also the cells at distance 1 of the halves with an even sum of counts.

    If two vectors differ by 3 at most, one of their halves differs by 1 at most: the cells are the same, or one of
    them has an even sum and the other is next to it.
    """
    code, halves = embedding(F.col("fp")), []
    for half in (0, 1):
        cell = F.shiftrightunsigned(code, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        rows = fps.select(F.lit(half).alias("half"), cell.alias("cell"), "fp")
        if probes:
            # Of a segment's code 00, 01, 11: the low bit may flip if the high one is 0, the high one if the low is 1.
            flip = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
            partner = F.array(*(F.lit(1 << (i ^ 1)).cast("long") for i in range(32)))
            fine = F.zip_with(flip, partner, lambda f, p: F.when((F.col("cell").bitwiseAND(p) != 0) == (f > p), F.col("cell").bitwiseXOR(f)))
            near = F.when(F.bit_count("cell") % 2 == 0, F.filter(fine, lambda c: c.isNotNull())).otherwise(F.array().cast("array<long>"))
            rows = rows.select("half", F.explode(F.concat(F.array("cell"), near)).alias("cell"), "fp")
        halves.append(rows)
    return halves[0].unionByName(halves[1])


def links(fps: DataFrame, max_bits: int = 3, cell_limit: int = CELL, scope: str = "") -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints: together they connect all that differ by max_bits (3 at most).

    Cells with up to cell_limit fingerprints: all pairs that the grid finds and that verify. In larger cells pairs would
    grow with the square; there every fingerprint visits the words within two bits of its own, and those that meet
    within one bit and two bits are linked to one of them: the same components, with links in proportion.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid serves up to 3 bits")
    homes = _cells(fps, probes=False)
    hot = saved(homes.groupBy("half", "cell").count().where(F.col("count") > cell_limit).select("half", "cell"), "simhash-hot", scope)
    visits = _cells(fps, probes=True)
    crowded = not hot.isEmpty()
    if crowded:
        known = lookup(hot)
        members = saved(visits.join(known, ["half", "cell"], "left_semi").select("fp").distinct(), "simhash-crowd", scope)
        homes, visits = homes.join(known, ["half", "cell"], "left_anti"), visits.join(known, ["half", "cell"], "left_anti")
    a, b = homes.select("half", "cell", F.col("fp").alias("a")), visits.select(F.col("half").alias("h"), F.col("cell").alias("c"), F.col("fp").alias("b"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    apart = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b"))))
    pairs = a.join(b, (F.col("half") == F.col("h")) & (F.col("cell") == F.col("c")) & (F.col("a") != F.col("b")) & (apart <= max_bits) & (differ <= max_bits))
    found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if crowded:
        found = found.unionByName(_meeting_links(members, max_bits, scope))
    return found.distinct()


def _meeting_links(members: DataFrame, max_bits: int, scope: str) -> DataFrame:
    far, near = (max_bits + 1) // 2, max_bits // 2
    masks = [0, *(1 << i for i in range(64))] + ([(1 << i) | (1 << j) for i in range(64) for j in range(i)] if far > 1 else [])
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks] if far else [0]
    each = members.select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
    words = saved(each.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"), F.bit_count("mask").alias("bits")), "simhash-words", scope)
    hubs = words.where(F.col("bits") <= near).groupBy(F.col("word").alias("w")).agg(F.min("fp").alias("hub"))
    met = words.join(saved(hubs, "simhash-hubs", scope), F.col("word") == F.col("w")).where("fp <> hub")
    return met.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))


def simhash_components(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3, cell_limit: int = CELL, scope: str = "") -> DataFrame:
    """One row per row of df: doc_id, fp (long), component_id (the smallest doc_id that links reach).

    A null or blank text has fingerprint 0 and is linked like any other. Null doc_ids never become a component_id
    unless a component has no other. Repeated rows and equal texts share a fingerprint and a component. An empty table
    gives no rows. Other columns of df have no part in it.
    """
    docs = saved(df.select(F.col(doc_id).alias("doc_id"), fingerprint_column(text, shingle).alias("fp")), "simhash-docs", scope)
    nodes = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-nodes", scope)
    roots = components(links(nodes.select("fp"), max_bits, cell_limit, scope), "simhash-links", scope).select(F.col("node").alias("fp"), "root")
    linked = saved(roots.join(nodes, "fp").select("fp", "root", "rep"), "simhash-linked", scope)
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    classes = linked.join(least, "root").select("fp", "least")
    alone = nodes.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("rep").alias("least"))
    classes = saved(classes.unionByName(alone).withColumn("known", F.lit(True)), "simhash-classes", scope)
    out = docs.join(lookup(classes), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("known"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


# Near-duplicates by similarity of word shingles.


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, scope: str = "") -> DataFrame:
    """Distinct texts in groups of near-duplicates: id (64 bits of the text's digest), keep_id, n, kept.

    kept says whether the text stays for its group: that with the smallest doc_id, null last. keep_id is the smallest
    doc_id of the n rows with that text. A link is a Jaccard similarity of word shingles (A-Z lower-cased, 64-bit hashes)
    of at least `percent`, verified on the whole sets; groups are those of all links, none is left out.

    Links within 3 bits of SimHash fingerprints come from the grid. As most pairs at 80 % differ by more bits than a grid
    can serve, the others come from the join of shingle sets. Texts without words, null ones too, are one group.
    """
    found = Texts(df, doc_id, text, shingle, percent, scope, fingerprint)
    roots = components(found.links(lambda rows: _grid_pairs(rows, scope)), "near-links", scope).withColumnRenamed("node", "id")
    linked = saved(found.groups.join(roots, "id").select("id", "keep_id", "root"), "near-linked", scope)
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("keep_id").isNull(), F.col("keep_id"), F.col("id"))).alias("best"))
    lost = linked.join(best, "root").where(F.col("best.id") != F.col("id")).select("id", F.lit(False).alias("stays"))
    return found.groups.join(lost, "id", "left").select("id", "keep_id", "n", F.coalesce("stays", F.lit(True)).alias("kept"))


def _grid_pairs(rows: DataFrame, scope: str) -> DataFrame:
    """Pairs (a, b) of each text and one of those that grid links of fingerprints connect it with."""
    grid = components(links(rows.select("fp").distinct(), 3, CELL, scope), "near-grid", scope).select(F.col("node").alias("fp"), "root")
    near = rows.where("id <> 0").select("id", "fp").distinct().join(grid, "fp", "left").select("id", F.coalesce("root", "fp").alias("root"))
    heads = near.groupBy("root").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").select("root", "head")
    return near.join(heads, "root").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))


def without_near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, scope: str = "") -> DataFrame:
    """The rows of df, one of each group of near-duplicates: that with the smallest doc_id. Columns stay as they are."""
    groups = near_duplicates(df, doc_id=doc_id, text=text, shingle=shingle, percent=percent, scope=scope)
    marked = saved(groups.where("n > 1 or not kept").select(F.col("id").alias("__id"), F.col("keep_id").alias("__keep"), F.col("kept").alias("__kept")), "near-result", scope)
    rows = df.withColumn("__of", text_id(F.col(text))).join(lookup(marked), F.col("__of") == F.col("__id"), "left")
    single = rows.where(F.col("__id").isNull()).select(*df.columns)
    copies = rows.where(F.col("__kept") & F.col(doc_id).eqNullSafe(F.col("__keep"))).dropDuplicates(["__of"]).select(*df.columns)
    return single.unionByName(copies)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_components(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
