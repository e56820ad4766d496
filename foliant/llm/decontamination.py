"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import runs, shingle_hashes, word_hashes

#: Hash functions; one agreement makes a candidate.
FUNCTIONS = 32
#: Shingles in the smallest block of a document, and bytes of test items that one index holds at most.
BLOCK, INDEX_BYTES = 8, 16 << 20
#: Bits of the table by which most minima are ruled out.
BITS = 20
MULTIPLIERS = np.random.default_rng(9).integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(h: np.ndarray) -> np.ndarray:
    """(functions, shingles)"""
    return h[None, :] * MULTIPLIERS[:, None]


def _slot(minima: np.ndarray) -> np.ndarray:
    return (minima >> np.uint64(8)) & np.uint64((1 << BITS) - 1)


class Index:
    """Test items in partitions by size: partition c > 0 holds items of up to 8 * 2^c distinct shingles.

    A document is searched for partition c in windows of two adjacent blocks of 8 * 2^c shingles. An item of the
    partition lies within such a window wherever it stands; item and window are then of like size, so that their Jaccard
    similarity is high (0.19 at least for a containment of 0.8) even if the document is long, and 32 minima agree at
    least once with probability 0.998.

    Partition 0 holds items of up to 8 shingles, of which minima would miss some: each is found by those of its shingles
    of which a document that contains it has one at least. Items of fewer than k words are runs of as many words.
    """

    def __init__(self, items: list[tuple[int, str]], k: int, containment: float = 0.8):
        self.k, self.containment = k, containment
        self.ids, self.sets, self.runs, parts, small = [], [], [], {}, {}
        for item_id, text in items:
            run = min(k, len(word_hashes(text)))
            h = np.unique(shingle_hashes(text, k))
            if len(h):
                c = max(0, int(np.ceil(np.log2(len(h) / BLOCK))))
                at = len(self.ids)
                if c:
                    parts.setdefault(c, []).append(at)
                else:
                    for x in h[: len(h) - int(np.ceil(containment * len(h) - 1e-9)) + 1].tolist():
                        small.setdefault(run, {}).setdefault(x, []).append(at)
                self.ids.append(item_id)
                self.sets.append(h)
                self.runs.append(run)
        #: By length of runs: the hashes to look for, in order, and the items that each may be of.
        self.small = {run: (np.array(sorted(found), np.uint64), found) for run, found in small.items()}
        self.parts = {}
        for c, members in sorted(parts.items()):
            minima = np.stack([minhashes(self.sets[i]).min(axis=1) for i in members])
            keys = [np.sort(minima[:, f]) for f in range(FUNCTIONS)]
            orders = [np.array(members)[np.argsort(minima[:, f], kind="stable")] for f in range(FUNCTIONS)]
            seen = np.zeros(1 << BITS, bool)
            seen[_slot(minima)] = True
            self.parts[c] = (keys, orders, seen)

    def looked_up(self, own: np.ndarray, run: int) -> list[int]:
        """Items of few shingles that a document with these runs may contain."""
        if run not in self.small or not len(own):
            return []
        keys, of = self.small[run]
        at = np.searchsorted(keys, own)
        return [i for x in own[keys[np.minimum(at, len(keys) - 1)] == own].tolist() for i in of[x]]

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items of more shingles."""
        found: set[int] = set()
        if not len(h) or not self.parts:
            return found
        blocks, level = np.minimum.reduceat(minhashes(h), np.arange(0, len(h), BLOCK), axis=1), 0
        for c, (keys, orders, seen) in self.parts.items():
            while level < c:
                blocks, level = np.minimum.reduceat(blocks, np.arange(0, blocks.shape[1], 2), axis=1), level + 1
            windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
            fs, ws = np.nonzero(seen[_slot(windows)])
            for f, value in set(zip(fs.tolist(), windows[fs, ws].tolist(), strict=True)):
                a, b = np.searchsorted(keys[f], [np.uint64(value)])[0], np.searchsorted(keys[f], [np.uint64(value)], side="right")[0]
                found.update(orders[f][a:b].tolist())
        return found

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared shingles, the item's shingles) of the items that the text contains."""
        words = word_hashes(text)
        found: dict[int, np.ndarray] = {}
        for run in {self.k, *self.small}:
            if len(words) < run:
                continue
            h = runs(words, run)
            near = self.candidates(h) if run == self.k else set()
            if near or run in self.small:
                own = np.unique(h)
                found |= dict.fromkeys([*near, *self.looked_up(own, run)], own)
        out = []
        for i, own in sorted(found.items(), key=lambda x: x[0]):
            shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
            if shared >= self.containment * len(self.sets[i]) - 1e-9:
                out.append((self.ids[i], shared, len(self.sets[i])))
        return out


def indexes(items: DataFrame, *, item_id: str = "item_id", text: str = "text", shingle: int = 5, containment: float = 0.8, index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all items, one after the other, each of about index_bytes of text; more items make more indexes, not larger ones.

    Items that are null or without words are in none. Repeated items are found as often as they stand in the table.
    """
    known = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // index_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        yield Index([(r["item_id"], r["text"]) for r in known.where(part == i).orderBy("item_id", "text").collect()], shingle, containment)


def matches_column(spark: SparkSession, index: Index, text: str) -> Column:
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("array<struct<item_id: long, shared: int, shingles: int>>")
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "shared": s, "shingles": n} for i, s, n in shared.value.matches(x)] for x in texts])

    return search(F.col(text))


def contained(df: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, containment: float = 0.8) -> DataFrame:
    """One row per document and test item it contains: doc_id, item_id, shared, shingles, containment.

    Containment is the share of the item's distinct word shingles (A-Z lower-cased) that the whole document has; an item
    of fewer words is one run, found wherever it stands. All items are searched for in all documents, in one pass per
    index, without a shuffle; a long text takes memory in proportion to itself. Null and empty texts, and items, match
    nothing; repeated rows and items are found as often as they stand there; an empty table on either side gives no
    rows. Other columns of either table have no part in it.
    """
    spark, out = df.sparkSession, None
    for index in indexes(items, item_id=item_id, text=item_text, shingle=shingle, containment=containment):
        rows = df.select(F.col(doc_id).alias("doc_id"), F.explode(matches_column(spark, index, text)).alias("m"))
        found = rows.select("doc_id", "m.item_id", "m.shared", "m.shingles", (F.col("m.shared") / F.col("m.shingles")).alias("containment"))
        out = found if out is None else out.unionByName(found)
    return out


def without_items(df: DataFrame, items: DataFrame, *, text: str = "text", shingle: int = 5, containment: float = 0.8) -> DataFrame:
    """The rows of df that contain no test item (see contained()); columns, null texts and repeated rows stay as they are."""
    out = df
    for index in indexes(items, shingle=shingle, containment=containment):
        out = out.withColumn("__found", matches_column(df.sparkSession, index, text)).where(F.size("__found") == 0).drop("__found")
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
