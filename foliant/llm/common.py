"""Helpers shared by the corpus operators: shared storage, bounded broadcasts, distributed ranks and components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes up to which a lookup table may be broadcast; beyond it a shuffle join is used.
BROADCAST_BYTES = 32 << 20

#: Texts that a Python worker is handed at a time.
TEXTS = 1000

#: Bits of a filter of hashes, at least and at most, as powers of two; bits in a block of it.
FILTER_BITS, FILTER_BLOCK = (16, 27), 1 << 16

#: Tables written by the stages of a pipeline: (scope, path).
_written: list[tuple[str, str]] = []
_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; on a local master without one, a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="corpus-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return f"file://{_local_dir[0]}"


def new_path(spark: SparkSession, name: str, scope: str = "") -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((scope, path))
    return path


def saved(df: DataFrame, name: str, scope: str = "", compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name, scope)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scope: str) -> None:
    """Deletes the tables that were written under a scope; nothing may read them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for kept in [x for x in _written if x[0] == scope]:
        path = jvm.org.apache.hadoop.fs.Path(kept[1])
        path.getFileSystem(conf).delete(path, True)
        _written.remove(kept)


def lookup(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows have at most `limit` bytes, 32 a row besides its values (measured); else Spark joins by shuffles."""
    size = F.lit(32)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            size = size + 8
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Python workers get a thousand texts at a time, not ten thousand: what they hold falls with it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS:
        spark.conf.set(key, str(TEXTS))


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """Two bits for each `hash` of a table (long), told by its first and by its last bits, of as many as FILTER_BITS allow for 16 a hash: 16 MB at most.

    Each task makes blocks of its own. Where hashes are so many that most bits are set, the filter lets most through.
    """
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * hashes.count()).bit_length()))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, np.ndarray] = {}
        for x in batches:
            at = x["at"].to_numpy()
            for block in np.unique(at // FILTER_BLOCK):
                blocks.setdefault(int(block), np.zeros(FILTER_BLOCK, bool))[at[at // FILTER_BLOCK == block] % FILTER_BLOCK] = True
        for block, found in blocks.items():
            yield pd.DataFrame({"block": [block], "bits": [np.packbits(found, bitorder="little").tobytes()]})

    at = F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)))
    dealt = hashes.select(F.explode(at).alias("at")).repartition(F.floor(F.col("at") / FILTER_BLOCK))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in dealt.mapInPandas(build, "block int, bits binary").collect():
        out[r["block"] * FILTER_BLOCK // 8 : (r["block"] + 1) * FILTER_BLOCK // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    size = (8 * len(bits) - 1).bit_length()
    of = lambda at: (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return of((hashes >> np.uint64(64 - size)).astype(np.int64)) & of((hashes & np.uint64((1 << size) - 1)).astype(np.int64))


def digest(text: Column) -> Column:
    """32 bytes that stand for the whole text; null for null."""
    return F.unhex(F.sha2(text, 256))


def ranked(df: DataFrame, keys: Sequence[Column], sums: dict[str, str], name: str, scope: str = "") -> tuple[DataFrame, list]:
    """Rows in the order of keys, with running totals over the whole table but no single-task window.

    The rows are range-partitioned by keys and written; each range gets a window of its own, and the totals of
    the ranges before it (one row per range on the driver) are added. Returns the table with columns
    `pid`, `rn` (from 1) and `upto_<name>` for each name of sums (name: column to add up), and the ranges' rows:
    pid, offset of rn, offsets of sums. Equal keys lie in one range.
    """
    spark = df.sparkSession
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    table = saved(keyed.repartitionByRange(*names).withColumn("pid", F.spark_partition_id()), name, scope)
    totals = table.groupBy("pid").agg(F.count("*").alias("n"), *(F.sum(c).alias(s) for s, c in sums.items())).orderBy("pid").collect()
    before, running = [], [0] * (1 + len(sums))
    for t in totals:
        before.append((t["pid"], *running))
        running = [a + (b or 0) for a, b in zip(running, t[1:], strict=True)]
    offsets = spark.createDataFrame(before or [(-1, *running)], "pid int, _n long" + "".join(f", _{s} long" for s in sums))
    w = Window.partitionBy("pid").orderBy(*names)
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    out = table.select("*", F.row_number().over(w).alias("_rn"), *(F.sum(c).over(rows).alias(f"_up_{s}") for s, c in sums.items())).join(F.broadcast(offsets), "pid")
    extra = [(F.col("_rn") + F.col("_n")).alias("rn"), *((F.col(f"_up_{s}") + F.col(f"_{s}")).alias(f"upto_{s}") for s in sums)]
    return out.select(*(c for c in df.columns), "pid", *names, *extra), totals


def components(edges: DataFrame, name: str = "components", scope: str = "") -> DataFrame:
    """Connected components of links (a, b), as (node, root) for every linked node; root is the smallest node.

    Each round maps every node to its smallest neighbour, follows that map once more, and contracts the links;
    the number of links falls with each round. Every table is written to the shared folder.
    """
    links = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name, scope)
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")).select("node", "root"), name, scope)
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        step = saved(step.join(jump, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), name, scope)
        maps.append(step)
        for end in ("a", "b"):
            links = links.join(step.select(F.col("node").alias(end), F.col("root").alias("_root")), end).drop(end).withColumnRenamed("_root", end)
        links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name, scope)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).where(F.lit(False))
    out = maps[0]
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return saved(out, name, scope) if len(maps) > 1 else out
