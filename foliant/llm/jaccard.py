"""Jaccard similarity join of word shingles by PartEnum signatures: a domain cut into groups of parts, and subsets of parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BITS, FILTER_BLOCK, bit_filter, components, lookup, passes, saved, small_batches
from .words import mixed, shingle_hashes

#: A size band's largest size is below STEP times its smallest. Parts of a group, of which all but one make a subset.
STEP, PARTS = 1.6, 2
#: Independent partitions of the domain; all but the last leave empty subsets out.
LEVELS = 4
#: Pairs for each text with a signature up to which all are compared; beyond, they must share a first shingle too.
CROWD = 4
#: Buckets (a power of two) in which shingles are counted, to have the rare ones first: at least and at most; in blocks.
BUCKET_BITS, COUNTED = (16, 24), 1 << 14
WORDS = r"[^\x20\x09-\x0D]"


class Band:
    """Sets of sizes from `first` to `last`, and the larger ones (up to `top`) that may be similar to one of them.

    Two sets of which the smaller has x elements are similar only if they differ in x * (100 - percent) / percent at most.
    The domain is cut into `groups`, each of PARTS parts. Of any floor(differ / 2) + 1 groups, one has one difference at
    most, so that one of its parts is the same in both. `emit` says for each size how many groups take part: some more
    than these `need`, since what both lack (an empty part) is no signature.
    """

    def __init__(self, first: int, percent: int):
        self.first, self.last = first, max(first, int(first * STEP) - 1)
        self.top = 100 * self.last // percent
        sizes = np.arange(first, self.last + 1)
        self.need = sizes * (100 - percent) // percent // 2 + 1
        self.groups = int(np.ceil(1.12 * self.need[-1])) + 2
        empty = PARTS * np.exp(-sizes / (PARTS * self.groups))
        enough = (self.need + 1 + 1.5 * np.sqrt(self.need * empty)) / np.maximum(0.25, 1 - empty)
        self.emit = np.maximum.accumulate(np.minimum(self.groups, np.ceil(enough)).astype(np.int64))


@cache
def bands(percent: int, upto: int) -> list[Band]:
    """The bands of all sizes up to a power of two; smaller sets than the first's are similar to equal ones only."""
    out, first = [], -(-percent // (100 - percent)) if percent < 100 else upto + 1
    while first <= upto:
        out.append(Band(first, percent))
        first = out[-1].last + 1
    return out


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """64-bit signatures of a set of distinct 64-bit hashes: two sets with 100 * shared >= percent * all have one in common.

    Of each band that the set belongs to, its elements in each part of the domain. A set of which more parts are empty
    than the band has to spare is unsettled and has those of the next partition too; of two unsettled sets both
    have, and the last partition has empty parts as well. So none of the similar pairs is lost.
    """
    n, out = len(h), []
    found = [(i, b) for i, b in enumerate(bands(percent, 1 << max(3, n.bit_length()))) if b.first <= n <= b.top]
    if not found:
        return mixed(np.array([np.add.reduce(mixed(h)) if n else 0], np.uint64) + np.uint64(n))[: min(n, 1)]
    bits = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
    for i, band in found:
        size = min(n, band.last)
        sizes = slice(max(band.first, -(-percent * n // 100)) - band.first, size - band.first + 1)
        emit, need = band.emit[sizes], band.need[sizes]
        for level in range(LEVELS):
            seed = np.uint64(1_000_003 * (LEVELS * i + level) + 7)
            slots = PARTS * band.groups
            part = (mixed(h + seed) % np.uint64(slots)).astype(np.int64)
            sums, counts = np.zeros(slots, np.uint64), np.bincount(part, minlength=slots)
            np.add.at(sums, part, bits)
            most = PARTS * int(emit[-1])
            empty = counts[:most] == 0
            each = mixed(sums[:most] + mixed(np.arange(most, dtype=np.uint64) + (seed << np.uint64(32))))
            bad = np.concatenate([[0], np.cumsum(empty.reshape(-1, PARTS).any(axis=1))])
            settled = bool((bad[emit] <= emit - need).all())
            out.append(each if level == LEVELS - 1 and not settled else each[~empty])
            if settled:
                break
    return np.unique(np.concatenate(out))


def _prefix(size: Column | np.ndarray | int, percent: int):
    """How many of a set's first shingles have one that a similar set shares, in any common order of all shingles."""
    ceil = F.ceil if isinstance(size, Column) else np.ceil
    return size - ceil(size * percent / 100) + 1


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits, about two for each hash, that tell how many hashes fall on each: odd or even.

    Two sets whose parities differ in n bits differ in n hashes at least; longer parities fold into shorter ones.
    """
    n = max(64, 1 << (2 * len(hashes)).bit_length())
    odd = np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8))


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two parities differ."""
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, n), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def text_id(text: Column) -> Column:
    """64 bits of a text's SHA-256, 0 for all texts without words: of 10^10 texts, about three pairs are taken for equal."""
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")
    return F.when(F.coalesce(text.rlike(WORDS), F.lit(False)), bits).otherwise(F.lit(0).cast("long"))


class Texts:
    """The distinct texts of df with their sets of shingles; rows: id, doc_id, size, sigs, odd (and fp), one for each row of df."""

    def __init__(self, df: DataFrame, doc_id: str, text: str, shingle: int, percent: int, scope: str, fingerprint: Callable[[np.ndarray], int] | None = None):
        if not 0 < percent <= 100:
            raise ValueError("percent is above 0 and at most 100")
        self.shingle, self.percent, self.scope = shingle, percent, scope
        small_batches(df.sparkSession)
        self.texts = df.select(text_id(F.col(text)).alias("id"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

        @F.pandas_udf("fp long, size long, sigs array<long>, odd binary")
        def sketch(values: pd.Series) -> pd.DataFrame:
            out = []
            for x in values:
                h = shingle_hashes(x, shingle)
                fp, h = fingerprint(h) if fingerprint else 0, np.unique(h)
                out.append((fp, len(h), signatures(h, percent).view(np.int64), parities(h).tobytes()))
            return pd.DataFrame(out, columns=["fp", "size", "sigs", "odd"])

        self.rows = saved(self.texts.select("id", "doc_id", sketch("text").alias("s"), F.monotonically_increasing_id().alias("row")).select("id", "doc_id", "row", "s.*"), "near-rows", scope)
        best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best")
        self.groups = saved(self.rows.groupBy("id").agg(best, F.count("*").alias("n")).select("id", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"), "near-texts", scope)

    def links(self, seeds: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Verified links (a, b) between ids of texts that connect all whose sets are similar; blank texts have none.

        Each text is first compared with the one that shares most of its signatures among those that head them (and with
        what seeds(rows) gives), which joins a group of copies in proportion to its size. Texts that this leaves apart
        and that share a signature are compared pair by pair.
        """
        shared = self._shared()
        pairs = _hub_pairs(shared, self.percent, self.scope)
        pairs = saved((pairs.unionByName(seeds(self.rows)) if seeds else pairs).distinct(), "near-pairs", self.scope)
        near = saved(self._verified(self._alike(pairs)), "near-first", self.scope)
        pairs = saved(self._open_pairs(shared, components(near, "near-links", self.scope)), "near-open", self.scope)
        return near.unionByName(saved(self._verified(self._alike(pairs)), "near-rest", self.scope))

    def _shared(self) -> DataFrame:
        """(id, hash, size, total) of the signatures that several texts have, and some more that a bounded filter lets through."""
        copies = saved(self.groups.where("n > 1").select("id", "keep_row"), "near-copies", self.scope)
        once = self.rows.where("id <> 0").join(lookup(copies), "id", "left").where("keep_row is null or keep_row = row")
        often = once.select(F.explode("sigs").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        filtered = self.rows.sparkSession.sparkContext.broadcast(bit_filter(saved(often, "near-often", self.scope)))

        @F.pandas_udf("array<long>")
        def known(values: pd.Series) -> pd.Series:
            return pd.Series([x[passes(filtered.value, x.view(np.uint64))] for x in values], dtype=object)

        each = once.select("id", "size", F.size("sigs").alias("total"), F.explode(known("sigs")).alias("hash"))
        return saved(each, "near-shared", self.scope)

    def _open_pairs(self, shared: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs (a, b) of texts with different roots that share a signature, among them all that are similar.

        Where signatures would give more than CROWD pairs a text, as those that are all of a common passage do, their
        texts must also share one of their first shingles, rare ones first; and where those are crowded too, beyond as many
        pairs as their texts have signatures here, a pair must share one of either at once.
        """
        marked = saved(shared.join(lookup(roots.withColumnRenamed("node", "id")), "id", "left").select("hash", "id", "size", F.coalesce("root", "id").alias("root"), F.lit(0).alias("at")), "near-marked", self.scope)
        left = saved(marked.join(lookup(saved(_open_keys(marked, "hash"), "near-keys", self.scope)), "hash"), "near-apart", self.scope)
        pairs = _pairs(left.where("not crowded"), ["hash"], self.percent)
        crowd = left.where("crowded").drop("crowded", "at")
        members = saved(crowd.groupBy("id").agg(F.any_value("root").alias("root"), F.any_value("size").alias("size")), "near-crowd", self.scope)
        if members.isEmpty():
            return pairs.distinct()
        first = saved(self._first_shingles(members), "near-first-shingles", self.scope)
        # Most shingles are those of one text: they go before anything else of their rows is shuffled.
        often = saved(first.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"), "near-often", self.scope)
        first = saved(first.join(lookup(often), "shingle"), "near-first-shingles", self.scope)
        met = first.join(lookup(saved(_open_keys(first, "shingle"), "near-keys", self.scope)), "shingle").join(lookup(saved(crowd.groupBy("id").agg(F.count("*").alias("sigs")), "near-sigs", self.scope)), "id")
        met = saved(met, "near-met", self.scope)
        # Each text has a row for each of its crowded signatures below: where pairs are no more than these, they are made at once.
        few = met.groupBy("shingle").agg((F.any_value("crowded") & (F.count("*") * F.count("*") / 2 > F.sum("sigs"))).alias("many"))
        met = saved(met.drop("crowded").join(lookup(saved(few, "near-keys", self.scope)), "shingle"), "near-met", self.scope)
        pairs = pairs.unionByName(_pairs(met.where("not many"), ["shingle"], self.percent))
        both = met.where("many").drop("many", "sigs").join(crowd.select("id", "hash"), "id")
        return pairs.unionByName(_pairs(both, ["shingle", "hash"], self.percent)).distinct()

    def _first_shingles(self, members: DataFrame) -> DataFrame:
        """(id, root, size, at, shingle): of each text as many of its shingles as one must be shared of with a similar set; those rare among these texts first.

        Most of them are in one text only; these are left out before rows are made of them, by a bounded filter that loses no other.
        """
        shingle, percent = self.shingle, self.percent
        found = self.texts.join(lookup(members), "id").groupBy("id").agg(*(F.any_value(c).alias(c) for c in ("text", "root", "size")))
        one = saved(found, "near-crowd-texts", self.scope)
        rarity = one.sparkSession.sparkContext.broadcast(_rarity(one, shingle, one.count()))

        @F.pandas_udf("array<long>")
        def first(values: pd.Series) -> pd.Series:
            counts, out = rarity.value, []
            shift = np.uint64(64 - (len(counts) - 1).bit_length())
            for x in values:
                h = np.unique(shingle_hashes(x, shingle))
                out.append(h[np.lexsort((h, counts[h >> shift]))[: int(_prefix(len(h), percent)) if len(h) else 0]].view(np.int64))
            return pd.Series(out, dtype=object)

        each = saved(one.select("id", "root", "size", first("text").alias("shingles")), "near-first", self.scope)
        repeated = one.sparkSession.sparkContext.broadcast(_repeated(each, each.agg(F.sum(F.size("shingles"))).first()[0] or 0))

        @F.pandas_udf("at array<int>, shingle array<long>")
        def shared(values: pd.Series) -> pd.DataFrame:
            bits, out = repeated.value, []
            for x in values:
                of = _bucket(x, 8 * len(bits))
                at = np.flatnonzero((bits[of >> 3] >> (of & 7).astype(np.uint8)) & 1)
                out.append((at.astype(np.int32), x[at]))
            return pd.DataFrame(out, columns=["at", "shingle"])

        return each.withColumn("s", shared("shingles")).select("id", "root", "size", F.inline(F.arrays_zip("s.at", "s.shingle")))

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that may be similar by sizes and parities, some 30 times smaller than the sets; none that is similar is lost."""
        wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-wanted", self.scope)
        sizes = saved(self.rows.join(lookup(wanted), "id", "left_semi").select("id", "size", "odd").dropDuplicates(["id"]), "near-sizes", self.scope)
        x, y = (sizes.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size"), F.col("odd").alias(f"{c}_odd")) for c in ("a", "b"))

        @F.pandas_udf("int")
        def apart(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([differing(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(a, b, strict=True)], dtype="int32")

        both = pairs.join(x, "a").join(y, "b").where(_comparable(F.col("a_size"), F.col("b_size"), self.percent))
        most = (100 - self.percent) / (100 + self.percent) * (F.col("a_size") + F.col("b_size")) + 1e-9
        return saved(both.where(apart("a_odd", "b_odd") <= most).select("a", "b"), "near-alike", self.scope)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose whole shingle sets are similar; sets are built for the texts of pairs only."""
        shingle, percent = self.shingle, self.percent

        @F.pandas_udf("binary")
        def shingles(values: pd.Series) -> pd.Series:
            return pd.Series([np.unique(shingle_hashes(x, shingle)).tobytes() for x in values])

        wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-wanted", self.scope)
        one = self.texts.join(lookup(wanted), "id", "left_semi").groupBy("id").agg(F.any_value("text").alias("text"))
        sets = saved(one.select("id", shingles("text").alias("set")), "near-sets", self.scope)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("a_set")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("b_set")), "b")

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                good = []
                for a, b in zip(x["a_set"], x["b_set"], strict=True):
                    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                    good.append(100 * both >= percent * (len(a) + len(b) - both))
                yield x.loc[np.array(good, bool), ["a", "b"]]

        return both.select("a", "b", "a_set", "b_set").mapInPandas(check, "a long, b long")


def _open_keys(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (key, id, root, at): keys that texts of several roots have, and whether they make more than CROWD pairs a text.

    Of keys that the very same texts have (by 64 bits of their ids' hashes) one stands for all, the first in the order of
    `at`: a pair that shares one of them shares them all.
    """
    by = rows.groupBy(key, "root").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("of"), F.min("at").alias("at"))
    by = by.groupBy(key).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("own"), F.bit_xor("of").alias("of"), F.min("at").alias("at"))
    one = by.where("n * n > own").groupBy("of", "n", "own").agg(F.min_by(key, F.struct("at", key)).alias(key))
    pairs = (F.col("n") * F.col("n") - F.col("own")) / 2
    return one.select(key, (pairs > CROWD * F.col("n")).alias("crowded"))


def _comparable(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _rarity(texts: DataFrame, shingle: int, rows: int) -> np.ndarray:
    """For each bucket of shingle hashes how many shingles all rows have in it, as a rounded logarithm.

    There are more buckets for more rows, up to a bound: 16 MB that every worker gets. A task's counts are shuffled as
    blocks of bytes, which compress well.
    """
    bits = min(BUCKET_BITS[1], max(BUCKET_BITS[0], (16 * rows).bit_length()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.uint32)
        for x in batches:
            for t in x["text"]:
                np.add.at(total, shingle_hashes(t, shingle) >> np.uint64(64 - bits), 1)
        for i in range(0, 1 << bits, COUNTED):
            part = total[i : i + COUNTED]
            if most := part.max():
                yield pd.DataFrame({"block": [i // COUNTED], "counts": [part.astype(np.uint8 if most < 256 else np.uint32).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for x in batches:
            for block, counts in zip(x["block"], x["counts"], strict=True):
                sums[block] = sums.get(block, np.zeros(COUNTED, np.int64)) + np.frombuffer(counts, np.uint8 if len(counts) == COUNTED else np.uint32)
        for block, total in sums.items():
            yield pd.DataFrame({"block": [block], "logs": [np.rint(np.log2(total + 1) * 6).astype(np.uint8).tobytes()]})

    counted = texts.select("text").mapInPandas(count, "block int, counts binary").repartition("block").mapInPandas(add, "block int, logs binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in counted.collect():
        out[r["block"] * COUNTED : (r["block"] + 1) * COUNTED] = np.frombuffer(r["logs"], np.uint8)
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return hashes.view(np.uint64) >> np.uint64(65 - buckets.bit_length())


def _repeated(sets: DataFrame, hashes: int) -> np.ndarray:
    """For each bucket of hashes whether two or more of the arrays `shingles` fall on it: none that two arrays share is missed.

    There are 16 buckets a hash, up to a bound; beyond, those of one array pass as well. What is shuffled is two bytes a hash.
    """
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * hashes).bit_length()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(at := np.sort(np.concatenate([np.zeros(0, np.uint64), *(_bucket(h, 1 << bits) for h in x["shingles"])]))):
                parts = np.split(at, np.flatnonzero(np.diff(at // FILTER_BLOCK)) + 1)
                yield pd.DataFrame({"block": [int(p[0] // FILTER_BLOCK) for p in parts], "at": [(p % FILTER_BLOCK).astype(np.uint16).tobytes() for p in parts]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, list[bytes]] = {}
        for x in batches:
            for block, at in zip(x["block"], x["at"], strict=True):
                known.setdefault(block, []).append(at)
        for block, parts in known.items():
            counts = np.bincount(np.frombuffer(b"".join(parts), np.uint16), minlength=FILTER_BLOCK)
            yield pd.DataFrame({"block": [block], "bits": [np.packbits(counts > 1, bitorder="little").tobytes()]})

    placed = sets.select("shingles").mapInPandas(place, "block int, at binary").repartition("block").mapInPandas(meet, "block int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in placed.collect():
        out[r["block"] * FILTER_BLOCK // 8 : (r["block"] + 1) * FILTER_BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _hub_pairs(shared: DataFrame, percent: int, scope: str) -> DataFrame:
    """Pairs (a, b) of each text and the one text, of those heading its signatures, that heads most of them.

    A signature is headed by the text of which the largest share of signatures stands in other texts too: a common
    origin has none of its own. There is one pair for each text at most, whatever the size of a group.
    """
    shares = shared.groupBy("id", "size", "total").agg(F.count("*").alias("met")).select("id", "size", (F.col("met") / F.col("total")).alias("share"))
    shares = saved(shares, "near-shares", scope)
    heads = shared.join(lookup(shares.drop("size")), "id").groupBy("hash").agg(F.max_by("id", F.struct("share", "id")).alias("head"), F.count("*").alias("n")).where("n > 1").select("hash", "head")
    sizes = shares.select(F.col("id").alias("head"), F.col("size").alias("head_size"))
    counted = shared.join(heads, "hash").where("id <> head").groupBy("id", "size", "head").agg(F.count("*").alias("n"))
    best = counted.join(sizes, "head").where(_comparable(F.col("size"), F.col("head_size"), percent)).groupBy("id").agg(F.max_by("head", F.struct("n", "head")).alias("head"))
    return best.select(F.col("id").alias("a"), F.col("head").alias("b"))


def _pairs(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs (a, b) of rows (keys, id, root, size, at) with equal keys and different roots whose sizes, and what follows `at` in both, suffice."""
    x, y = (rows.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in ("id", "root", "size", "at"))) for s in "xy")
    longer = (F.col("x_size") > F.col("y_size")) | (F.col("x_size") == F.col("y_size")) & (F.col("x_id") > F.col("y_id"))
    rest = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    enough = _comparable(F.col("x_size"), F.col("y_size"), percent) & ((100 + percent) * rest >= percent * (F.col("x_size") + F.col("y_size")))
    pairs = x.join(y, keys).where((F.col("x_root") != F.col("y_root")) & longer & enough)
    return pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))


def jaccard_components(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, scope: str = "") -> DataFrame:
    """One row per row of df: doc_id, n_shingles (distinct), component_id (the smallest doc_id that links reach, itself included).

    Texts link if 100 * shared >= percent * all of their word shingles (A-Z lower-cased; told apart by 64-bit hashes).
    Shorter texts than a shingle have the whole sequence as one. Texts without words, null ones too, have none and link
    with nothing, not even each other. Equal texts and repeated rows link. A null doc_id is a component_id only
    where a component has no other. Other columns of df have no part in it; an empty table gives no rows. Every link is
    verified on whole sets, and what the links connect is whole; links that add nothing to it aren't listed.
    """
    found = Texts(df, doc_id, text, shingle, percent, scope)
    roots = components(found.links(), "jaccard-links", scope).withColumnRenamed("node", "id")
    linked = saved(found.groups.where("id <> 0").join(roots, "id", "left").select("id", "keep_id", "n", F.coalesce("root", "id").alias("root")), "jaccard-texts", scope)
    least = linked.groupBy("root").agg(F.min("keep_id").alias("least"), F.sum("n").alias("size")).where("size > 1").select("root", "least")
    classes = saved(linked.join(least, "root").select("id", "least", F.lit(True).alias("known")), "jaccard-classes", scope)
    out = found.rows.select("id", "doc_id", "size").join(lookup(classes), "id", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("known"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM met JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
either AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, b FROM r JOIN either ON reached = a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id"""
