"""Fill-in-the-middle: texts cut at two ranks of their units, the parts reordered behind markers; exactly reversible."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A unit is a word with the white space before it; white space at the end is a unit of its own.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKERS = ("<P>", "<S>", "<M>")


def count_units(text: str) -> int:
    """The first pass: matches are counted one by one, none is kept."""
    return sum(1 for _ in UNIT.finditer(text))


def ends_of(text: str, ranks: tuple[int, ...]) -> Iterator[int]:
    """The second pass: where the unit of each rank (from 1, in ascending order; 0: the text's start) ends.

    One lazy iterator of matches advances from rank to rank and stops at the last; no list of units exists.
    """
    matches, at, end = UNIT.finditer(text), 0, 0
    for rank in ranks:
        for m in islice(matches, rank - at):
            end = m.end()
        at = rank
        yield end


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the SHA-256 of seed and doc_id; a null doc_id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """One row per row of df: doc_id, n (units), form, prefix_chars, middle_chars (code points), output.

    Of texts, `percent` are cut at two drawn ranks into prefix, middle and suffix; of those, `spm_percent` have the form
    spm (suffix, prefix, middle), the others psm (prefix, suffix, middle). All others are plain, as are empty texts and
    those that hold a marker; their output is the text and both lengths are null. Null texts are empty; a null doc_id
    draws like an empty one; rows of equal doc_id and text have equal outputs. Other columns of df have no part in it; an
    empty table gives no rows. A worker holds a batch of texts and two numbers of each, whatever their lengths.
    """
    _checked(markers)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long")
    def cut(texts: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        out = []
        for x, a, b, c, d in zip(texts, h1, h2, h3, h4, strict=True):
            n = count_units(x)
            if not x or c % 100 >= percent or any(m in x for m in markers):
                out.append((n, "plain", None, None))
                continue
            first, last = ends_of(x, tuple(sorted((a % (n + 1), b % (n + 1)))))
            out.append((n, "spm" if d % 100 < spm_percent else "psm", first, last - first))
        found = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars"])
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col(doc_id), seed), 1)))
    rows = rows.select("doc_id", "text", cut("text", "h1", "h2", "h3", "h4").alias("c")).select("doc_id", "text", "c.*")
    start, size = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring("text", F.lit(1), start), F.substring("text", start + 1, size)
    suffix = F.substring("text", start + size + 1, F.length("text"))
    p, s, m = map(F.lit, markers)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, from output and form alone: the parts hold no marker, so that each marker is found where it was put."""
    _checked(markers)
    p, s, m = markers
    part = lambda a, b: F.substring(output, a, b - a)
    end = F.length(output) + 1
    at_p, at_s, at_m = (F.instr(output, x) for x in (p, s, m))
    middle = part(at_m + len(m), end)
    psm = F.concat(part(at_p + len(p), at_s), middle, part(at_s + len(s), at_m))
    spm = F.concat(part(at_p + len(p), at_m), middle, part(at_s + len(s), at_p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _checked(markers: tuple[str, str, str]) -> None:
    """A marker begins with a character that stands nowhere else in markers, so that none can arise across a seam."""
    if len(set(markers)) != 3 or any(not m or m[0] != markers[0][0] or m[0] in m[1:] for m in markers) or any(a != b and a.startswith(b) for a in markers for b in markers):
        raise ValueError("markers are three different texts, none the start of another, that share a first character which they hold only once")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda x: F.sha2(x, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, list_transform(range(4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS r FROM d),
c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS x, array_to_string(units[a + 1:b], '') AS y, array_to_string(units[b + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE '<P>' || x || '<S>' || z || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
