"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding; each stage on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common, decontamination, language, mixing, sharding, simhash

SCOPE = "pipeline"
#: Documents whose best language has a smaller share are rejected, as are those without letters.
LEAST_SCORE = 0.3
SHARDS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a language: those without letters go, null texts too, and those whose best language has less than LEAST_SCORE.

    Columns stay as they are, whatever their names; equal texts stay or go together; an empty table gives an empty one.
    """
    common.release(spark, SCOPE)
    found = docs.withColumn("__found", language.predict_column(spark, language.train(docs), "text"))
    return found.where((F.col("__found.lang_pred") != "und") & (F.col("__found.score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, null last.

    Texts without words, null ones too, are one group; of rows that agree in doc_id and text one stays. Columns stay as
    they are, whatever their names; an empty table gives an empty one.
    """
    common.release(spark, SCOPE)
    return simhash.without_near_duplicates(docs, scope=SCOPE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no item of `benchmark`; null texts contain none. Columns and repeated rows stay as they are."""
    common.release(spark, SCOPE)
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, null sources and null texts like any other.

    Columns stay as they are, whatever their names; of equal rows as many are taken as the target leaves room for.
    """
    common.release(spark, SCOPE)
    whole = docs.select("doc_id", "text", "source", F.struct(*(docs[c] for c in docs.columns)).alias("__doc"))
    mixed = mixing.mix(whole, scope=SCOPE).where("repetitions > 0")
    return mixed.select("__doc", F.explode(F.sequence(F.lit(1), F.col("repetitions")))).select("__doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `shard` (0 to SHARDS - 1), which replaces a column of that name; equal texts share one.

    Null texts are one group. All other columns stay; an empty table gives an empty one.
    """
    common.release(spark, SCOPE)
    return sharding.assigned(docs, SHARDS, scope=SCOPE)


#: Each is written as Parquet and read again as the next one's docs; what a stage wrote is deleted when the next begins.
STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The stages learn a model, hash words and search; SQL has no form of them. tests/llm holds each stage, and run(), against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted once the next one's is written; one run at a time in a process."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}", f"{SCOPE}-{name}")
        if before:
            common.release(spark, before)
        before = f"{SCOPE}-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
