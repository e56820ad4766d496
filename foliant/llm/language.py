"""Language ID: known words by per-language log frequency, unseen words by progressively shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled documents that training reads at most (those with the smallest hashes).
TRAIN_DOCS = 4000
LONGEST = 4
#: Distinct words whose scores a Python worker remembers, and those of a text that are added up at a time.
REMEMBERED, CHUNK = 1 << 17, 1 << 13
#: Runs of letters, and of numbers that aren't decimal, such as fractions and Roman ones.
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_counts(text: str | None) -> Counter:
    """How often each run of letters (as \\p{L}+ in Java) stands in a text, lower-cased."""
    counts = Counter(LETTERS.findall((text or "").lower()))
    for word in [w for w in counts if not w.isalpha()]:
        n = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += n
    return counts


class Model:
    """Log frequencies of words and n-grams: rows of a table with a number per language."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.langs = sorted({lang for _, lang in counts}) or ["und"]
        size = len(self.langs)
        words, grams = [Counter() for _ in self.langs], [Counter() for _ in self.langs]
        for (word, lang), n in counts.items():
            at = self.langs.index(lang)
            words[at][word] += n
            for k in range(1, LONGEST + 1):
                for g in _grams(word, k):
                    grams[at][g] += n
        known = _logs(words, lambda _: 0, 2)
        parts = {g: row - row.max() - (LONGEST - len(g)) * log(2) for g, row in _logs(grams, len, 2).items()}
        #: Rows of the table: the known words' logs, then the n-grams', less their best and log 2 for each step back; then zeros.
        self.words = {w: (i,) for i, w in enumerate(known)}
        self.grams = {g: len(known) + i for i, g in enumerate(parts)}
        self.table = np.array([*known.values(), *parts.values(), np.zeros(size)]).reshape(len(known) + len(parts) + 1, size)

    def rows(self, word: str) -> tuple[int, ...]:
        """The rows that add up to a word's score: its own, if it is known, or that of the longest known n-gram at each position."""
        if own := self.words.get(word):
            return own
        padded, out, get = f" {word} ", [], self.grams.get
        for i in range(len(padded)):
            for k in range(LONGEST, 0, -1):
                if (row := get(padded[i : i + k])) is not None:
                    out.append(row)
                    break
        return tuple(out)


def _grams(word: str, k: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + k] for i in range(len(padded) - k + 1)]


def _logs(counts: list[Counter], kind: Callable[[str], int], least: int) -> dict[str, np.ndarray]:
    """Smoothed log frequencies by language, among the entries of the same kind; those that occur `least` times are kept."""
    every = sorted(set().union(*counts))
    table = np.array([[c[x] for x in every] for c in counts], float).T.reshape(len(every), len(counts))
    often, kinds = table.sum(axis=1) >= least, np.array([kind(x) for x in every], int)
    for k in set(kinds.tolist()):
        own = kinds == k
        table[own] = np.log((table[own] + 0.1) / (table[own].sum(axis=0) + 0.1 * own.sum()))
    return {every[i]: table[i] for i in np.flatnonzero(often)}


class Scorer:
    """Predicts whole texts; remembers the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.met: dict[str, int] = {}
        self.scores = np.zeros((REMEMBERED, len(model.langs)))

    def learn(self, words: list[str]) -> None:
        """Adds up the scores of words that it hasn't met; a row of zeros stands for no row."""
        if len(self.met) + len(words) > REMEMBERED:
            self.met.clear()
        flat: list[int] = []
        starts = []
        for word in words:
            starts.append(len(flat))
            flat += self.model.rows(word)
            flat.append(-1)
        first = len(self.met)
        self.scores[first : first + len(words)] = np.add.reduceat(self.model.table[flat], starts, axis=0)
        self.met.update(zip(words, range(first, first + len(words)), strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = word_counts(text)
        if not counts:
            return "und", 0.0
        total, every = np.zeros(len(self.model.langs)), list(counts.items())
        for i in range(0, len(every), CHUNK):
            part = every[i : i + CHUNK]
            words = [word for word, _ in part]
            if new := [word for word in words if word not in self.met]:
                self.learn(new if len(self.met) + len(new) <= REMEMBERED else words)
            total += np.array([n for _, n in part], float) @ self.scores[[self.met[word] for word in words]]
        # The share of the best language, as if the text were of at most 20 words.
        mean = (total - total.max()) * min(1.0, 20 / sum(counts.values()))
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(mean).sum())


def train(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: Column | None = None, max_docs: int = TRAIN_DOCS) -> Model:
    """Learns from text and non-null lang of at most max_docs documents (fold: a condition on those to learn from).

    The bound makes the cost of training the same at any size. The sample is that of the smallest hashes of (doc_id,
    text), null doc_ids too, rows that agree in both together; Spark counts its words by language, and the driver gets
    them all. Without labelled rows, or from an empty table, the model knows no language and predicts `und`.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.where(fold) if fold is not None else labelled
    hashed = F.xxhash64(F.lit("language"), F.col(doc_id), F.col(text))
    last = labelled.select(hashed.alias("h")).orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    if last is None:
        return Model({})
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    counted = labelled.where(hashed <= last).select(F.col(lang).alias("lang"), words).groupBy("word", "lang").count()
    return Model({(r["word"], r["lang"]): r["count"] for r in counted.collect()})


def predict_column(spark: SparkSession, model: Model, text: str) -> Column:
    """struct<lang_pred, score>; `und` and 0 for null texts and texts without letters."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not scorers:
            scorers.append(Scorer(shared.value))
        return pd.DataFrame([scorers[0].predict(x) for x in texts], columns=["lang_pred", "score"])

    return predict(F.col(text))


def identify(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of df with `lang_pred` and `score` (0 to 1); columns of these names are replaced, others stay.

    A null text, and one without letters, is `und` with 0. Equal texts, repeated rows too, are predicted alike, null
    doc_ids like any other; a long text is scored whole, each distinct word once. An empty table gives an empty one.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    out = df.select(*(df[c] for c in kept), predict_column(df.sparkSession, model, text).alias("__pred"))
    return out.select(*kept, "__pred.lang_pred", "__pred.score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, fold=~held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
