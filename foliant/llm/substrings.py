"""Substring dedup: sliding spans of consecutive sentences, joined globally."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_filter, lookup, passes, saved, small_batches

#: Characters of scripts that don't part words (Chinese, Japanese, Thai, Lao, Burmese, Khmer): each counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Sentences end at white space after . ! or ?, at line ends, and after the full stops and marks of other scripts.
BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*|(?<=[\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965\u1362\u104b\u17d4])\s*")
WORD = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
#: Sentences of so many words or more are cut behind the word with the least hash of each WINDOW words: alike wherever a passage stands.
LONG, WINDOW = 40, 10
#: A span is the shortest run of at least so many sentences, with at least so many words, that begins or ends somewhere.
MIN_SENTENCES, MIN_WORDS = 2, 20


def cuts(words: list[str]) -> list[int]:
    """Behind which words a long sentence is cut: never more than WINDOW words apart, and told by the words around alone.

    So of a passage of 40 words that stands in two long sentences, the same 20 words or more are whole pieces in both: the first
    cut comes within 10 words, and the pieces from there, of 10 words at most, make 20 words before the passage ends.
    """
    h = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint32, len(words))
    at = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)
    return np.unique(at).tolist()


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Where each sentence begins and ends; blank ones don't count, long ones are several."""
    out, start = [], 0
    for m in [*BREAK.finditer(text := text or ""), None]:
        end = m.start() if m else len(text)
        if end - start >= LONG and len(words := list(WORD.finditer(text, start, end))) >= LONG:
            first = start
            for i in cuts([w[0] for w in words]):
                if i + 1 < len(words):
                    out.append((first, words[i].end()))
                    first = words[i + 1].start()
            out.append((first, end))
        elif text[start:end].strip():
            out.append((start, end))
        start = m.end() if m else end
    return out


def spans(text: str | None, min_sentences: int, min_words: int) -> list[tuple[bytes, int, int]]:
    """(hash, first, last) of the shortest runs, of those with enough sentences and words, that begin or end at each sentence.

    They cover what all such runs of any length would. Of a run, every sentence lies in a span within the run: in the
    one that begins with the run, or, if that ends before it, in the one that ends with the sentence. And where a run
    repeats an earlier one, its spans repeat the earlier one's. White space is made one space.
    """
    parts = [text[a:b] for a, b in sentences(text)]
    lines, sizes = [" ".join(x.split()) for x in parts], [sum(1 for _ in WORD.finditer(x)) for x in parts]
    found, end, count = set(), 0, 0
    for i in range(len(lines)):
        while end < len(lines) and (end - i < min_sentences or count < min_words):
            count += sizes[end]
            end += 1
        if end - i < min_sentences or count < min_words:
            break
        found.add((i, end - 1))
        count -= sizes[i]
    start, count = 0, 0
    for j in range(len(lines)):
        count += sizes[j]
        while j - start >= min_sentences and count - sizes[start] >= min_words:
            count -= sizes[start]
            start += 1
        if j + 1 - start >= min_sentences and count >= min_words:
            found.add((start, j))
    return [(xxhash.xxh128_digest("\n".join(lines[i : j + 1])), i, j) for i, j in sorted(found)]


def repeated_spans(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, scope: str = "") -> DataFrame:
    """Every span that is not the first of its kind: doc_id, text_hash, first, last (sentences from 0), first_doc_id.

    The first of a kind is that with the smallest (doc_id, XXH64 of the text, position), null doc_ids last. A document's
    own repeats are settled in the document, so that only one row per document and kind is joined. Rows that agree in
    doc_id and text are one document; those that agree in doc_id only, or have none, are several. Null, empty and short
    texts have no spans; a long text gives two spans a sentence. Where a script doesn't part words, each of its characters
    counts as one. A passage within sentences of under LONG words is found by whole sentences only. An empty table gives
    no rows. Other columns of df have no part in it.
    """

    small_batches(df.sparkSession)

    @F.pandas_udf("high array<long>, low array<long>, first array<int>, last array<int>, again array<boolean>")
    def split(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            rows, met = spans(x, min_sentences, min_words), set()
            halves = np.frombuffer(b"".join(h for h, _, _ in rows), ">i8").astype(np.int64).reshape(-1, 2)
            again = np.fromiter((h in met or met.add(h) is not None for h, _, _ in rows), bool, len(rows))
            first, last = (np.fromiter((r[i] for r in rows), np.int32, len(rows)) for i in (1, 2))
            out.append((halves[:, 0], halves[:, 1], first, last, again))
        return pd.DataFrame(out, columns=["high", "low", "first", "last", "again"])

    own = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), split(F.col(text)).alias("s")).select("doc_id", "text_hash", "s.*")
    found = saved(own.select("doc_id", "text_hash", F.inline(F.arrays_zip("high", "low", "first", "last", "again"))), "spans", scope)
    singles = found.where("not again").select("high", "low", "doc_id", "text_hash", "first", "last")
    # Most spans stand once: half a hash and a count are all that is shuffled of them.
    often = singles.groupBy(F.col("low").alias("hash")).agg(F.count("*").alias("n")).where("n > 1").select("hash")
    bits = df.sparkSession.sparkContext.broadcast(bit_filter(saved(often, "spans-often", scope)))

    @F.pandas_udf("boolean")
    def several(low: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, low.to_numpy().view(np.uint64)))

    singles = singles.where(several("low"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "first")
    kinds = singles.groupBy("high", "low").agg(F.min(place).alias("at"), F.max(place).alias("to")).where("at <> to").select("high", "low", "at")
    kinds = saved(kinds, "span-kinds", scope)
    met = singles.join(kinds, ["high", "low"]).where(~place.eqNullSafe(F.col("at")))
    again = found.where("again").select("doc_id", "text_hash", "first", "last", F.col("doc_id").alias("first_doc_id"))
    return met.select("doc_id", "text_hash", "first", "last", F.col("at.doc_id").alias("first_doc_id")).unionByName(again)


def covered(hits: DataFrame) -> DataFrame:
    """Spans that overlap or touch, made one: doc_id, text_hash, first, last, spans, first_doc_id (the smallest)."""
    hits = hits.groupBy("doc_id", "text_hash", "first").agg(F.max("last").alias("last"), F.min("first_doc_id").alias("first_doc_id"), F.count("*").alias("n"))
    w = Window.partitionBy("doc_id", "text_hash").orderBy("first")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("opens", F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0))
    numbered = opened.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("doc_id", "text_hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("spans"), F.min("first_doc_id").alias("first_doc_id"))
    return out.drop("run")


def without_repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, scope: str = "") -> DataFrame:
    """The rows of df, their texts without the sentences that a non-first repeated span covers; null texts stay null.

    A text is cut by its own spans only, also where doc_ids repeat or are null. Rows that agree in doc_id and text are
    one document and keep the same sentences. An empty table gives an empty one.
    """
    cuts = covered(repeated_spans(df, doc_id=doc_id, text=text, min_sentences=min_sentences, min_words=min_words, scope=scope))
    cuts = saved(cuts.groupBy(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__hash")).agg(F.collect_list(F.struct("first", "last")).alias("__cuts")), "span-cuts", scope)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for x, c in zip(texts, cuts, strict=True):
            if x is not None and c is not None:
                at = sentences(x)
                for s in sorted(c, key=lambda s: -s["first"]):
                    x = x[: at[s["first"]][0]] + (x[at[s["last"] + 1][0] :] if s["last"] + 1 < len(at) else "")
            out.append(x)
        return pd.Series(out, dtype=object)

    joined = df.join(lookup(cuts), F.col(doc_id).eqNullSafe(F.col("__of")) & (F.xxhash64(F.col(text)) == F.col("__hash")), "left")
    return joined.withColumn("__new", cut(F.col(text), F.col("__cuts"))).select(*(F.col("__new").alias(c) if c == text else df[c] for c in df.columns))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run of removed sentences, with the document that has the first of its spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = covered(repeated_spans(docs))
    return out.select("doc_id", F.col("first").alias("first_sentence"), F.col("last").alias("last_sentence"), (F.col("last") - F.col("first") + 1).alias("n_sentences"), F.col("spans").alias("n_spans"), "first_doc_id")
