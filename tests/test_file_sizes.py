"""Files that hold their content compressed: what they hold is told as it was, and takes less."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliant.sources import files


@pytest.mark.parametrize("compression", [None, "zstd", "gzip"])
def test_described_files(spark, tmp_path, compression):
    content = {f"d{i}.txt": f"é {i} " * (300_000 if i == 7 else i) for i in range(12)}
    df = spark.createDataFrame([*content.items(), ("none.txt", None)], "name string, content string").repartition(3)
    files.write_files(df, str(tmp_path / "out"), compression=compression)
    got = {r.name: (r["size"], r.sha256) for r in files.described_files(spark, str(tmp_path / "out"), compression).collect()}
    want = {k: v.encode() for k, v in (content | {"none.txt": ""}).items() if v or compression}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()}
    with pytest.raises(ValueError, match="no compression"):
        files.write_files(df, str(tmp_path / "other"), compression="none at all")


def test_document_files_take_less_than_they_hold(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr("foliant.sources.storage.new_path", lambda spark, name: f"file://{tmp_path}/{name}")
    held = entry.queries()["document_files"](spark, sf).agg(F.sum("size")).first()[0]
    disk = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names)
    assert 4 * disk < held
