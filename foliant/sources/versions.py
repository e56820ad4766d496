"""Keyed tables that are merged into: new versions of the buckets that change, and a pointer that moves at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another merge was there first; the table is as that one left it."""


class VersionedTable:
    """Rows by key in a fixed number of buckets. A version tells for each bucket the folder that holds it.

    `_versions/<n>.json` is written aside and renamed, which fails if another writer made that version: readers see one
    version or the next, and of two merges of the same version one wins. Older versions stay readable.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("_versions")
        store = folder.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _load(self, version: int) -> dict:
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/_versions/{version}.json").collect()))

    def _commit(self, version: int, state: dict) -> None:
        target, aside = self._path(f"_versions/{version}.json"), self._path(f"_versions/_{uuid.uuid4().hex}")
        store = target.getFileSystem(self._conf)
        out = store.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if store.exists(target):
            store.delete(aside, False)
            raise Conflict(f"version {version} is there")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(aside, target, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as failed:
            store.delete(aside, False)
            raise Conflict(f"version {version} is there") from failed

    def _bucket(self, keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: Sequence[str], buckets: int) -> dict[str, str]:
        """The folders of the buckets that rows have."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        at = self._path(folder)
        names = [s.getPath().getName() for s in at.getFileSystem(self._conf).listStatus(at)]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def create(self, rows: DataFrame, keys: Sequence[str], buckets: int = 16) -> int:
        """Version 0. Of rows with one key any may be kept, so there should be one; null keys are keys."""
        one = rows.dropDuplicates(list(keys))
        self._commit(0, {"keys": list(keys), "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": self._write(one, keys, buckets)})
        return 0

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or was at a version."""
        return self._read(self._load(self.versions()[-1] if version is None else version))

    def _read(self, state: dict, only: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        folders = [f"{self.root}/{f}" for b, f in sorted(state["folders"].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def merge(self, updates: DataFrame, order: Column | None = None) -> int:
        """A new version: rows with an update's key take its columns, others of theirs; keys that aren't there are inserted.

        Columns that updates lack stay, or are null in new rows. Of several updates of a key the last by `order` counts, any
        without. Only buckets that updates touch are read and written. No updates, no new version.
        """
        version = self.versions()[-1]
        state = self._load(version)
        keys, buckets, schema = state["keys"], state["buckets"], StructType.fromJson(state["schema"])
        if extra := set(updates.columns) - set(schema.names):
            raise ValueError(f"the table has no column {', '.join(sorted(extra))}")
        if order is None:
            last = updates.dropDuplicates(keys)
        else:
            last = updates.groupBy(*keys).agg(F.max_by(F.struct(*updates.columns), order).alias("u")).select("u.*")
        touched = [str(r["b"]) for r in last.select(self._bucket(keys, buckets).alias("b")).distinct().collect()]  # as many as buckets at most
        if not touched:
            return version
        old = self._read(state, touched).select("*", F.lit(True).alias("_old")).alias("o")
        new = last.select("*", F.lit(True).alias("_new")).alias("n")
        both = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
        is_new = F.col("n._new").isNotNull()
        value = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in updates.columns else F.col(f"o.{c}")
        merged = both.select(*(value(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        self._commit(version + 1, state | {"folders": state["folders"] | self._write(merged, keys, buckets)})
        return version + 1
