"""Exports of tokens, regions and table cells: rows for CSV, nested JSON, XML, text and reports, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from foliant.functions import scalars
from foliant.operators import layout

FORMATS = ("parquet", "json", "csv", "xml", "txt", "orc")


def flat_rows(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Regions and table cells in one table of one schema; what a kind doesn't have is null. Empty cells are left out."""
    text = regions.select("doc_id", F.col("page_num").cast("long").alias("page"), F.col("region_text").alias("text"), "confidence", F.lit("text").alias("type"), F.col("x1").cast("long").alias("x"), F.col("y1").cast("long").alias("y"))
    cell = cells.where(F.trim("cell_text") != "").select(
        "doc_id", F.col("page_num").cast("long").alias("page"), F.col("cell_text").alias("text"), F.lit(1.0).alias("confidence"), F.lit("table_cell").alias("type"), F.col("table_num").cast("long").alias("table"),
        F.col("row_num").cast("long").alias("row"), F.col("column_num").cast("long").alias("column"),
    )
    return text.unionByName(cell, allowMissingColumns=True)


#: Columns that an export may have.
MOST_COLUMNS = 1000


def dynamic_columns(rows: DataFrame, keys: list[str] | None = None, most: int = MOST_COLUMNS) -> tuple[DataFrame, list[str]]:
    """rows with a map or JSON objects in `columns`: one column for each key of any row, in order, '' where a row lacks it or has null.

    The objects become variants, whose common schema is an aggregate; it names the columns of the plan, `most` at most, else
    it is an error that tells so before the schema is made. keys spares both passes. What is no JSON object has no keys.
    Values are told as text.
    """
    if isinstance(rows.schema["columns"].dataType, MapType):
        rows = rows.withColumn("columns", F.to_json("columns"))
    parsed = rows.withColumn("columns", F.try_parse_json("columns"))
    if keys is None:
        found = rows.select(F.explode(F.map_keys(F.from_json("columns", "map<string, string>"))).alias("k"))
        if found.distinct().limit(most + 1).count() > most:
            raise ValueError(f"the rows have more than {most} columns")
        objects = F.when(F.startswith(F.schema_of_variant("columns"), F.lit("OBJECT")), F.col("columns"))
        shape = parsed.agg(F.schema_of_variant_agg(objects).alias("s")).first()["s"] or ""
        keys = sorted(StructType.fromDDL(shape.replace("OBJECT<", "STRUCT<")[7:-1]).names) if shape.startswith("OBJECT<") and shape != "OBJECT<>" else []

    def told(k: str) -> Column:
        quote = "'" if "'" not in k else '"'
        if quote not in k:
            return F.try_variant_get("columns", f"$[{quote}{k}{quote}]", "string")
        return F.try_element_at(F.try_variant_get("columns", "$", "map<string, string>"), F.lit(k))

    return parsed.select(*(c for c in rows.columns if c != "columns"), *(F.coalesce(told(k), F.lit("")).alias(k) for k in keys)), keys


def page_json(tokens: DataFrame, boxes: bool = True, confidences: bool = True) -> DataFrame:
    """By document a JSON text of its pages and their tokens; boxes and confidences can be left out."""
    def told(of) -> Column:
        fields: list[Column] = [of("text").alias("text")]
        fields += [F.array(*map(of, ("x1", "y1", "x2", "y2"))).alias("bbox")] if boxes else []
        fields += [of("confidence").alias("confidence")] if confidences else []
        return F.struct(*fields)

    if "pages" in tokens.columns:
        # Documents that hold their pages (tables.paged): nothing is gathered.
        listed = F.transform("pages", lambda p: F.struct(p.page_num.alias("page_num"), F.transform(p.ts, lambda t: told(t.__getitem__)).alias("tokens")))
        return tokens.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), listed.alias("pages"))).alias("json"))
    pages = tokens.groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("pos", told(F.col).alias("t")))).alias("ts"))
    nested = pages.select("doc_id", F.struct("page_num", F.transform("ts", lambda t: t.t).alias("tokens")).alias("page"))
    return nested.groupBy("doc_id").agg(F.to_json(F.struct(F.first("doc_id").alias("id"), F.array_sort(F.collect_list("page")).alias("pages"))).alias("json"))


def page_xml(tokens: DataFrame) -> DataFrame:
    """By page an XML element with its text and mean confidence."""
    words = F.sort_array(F.transform("ts", lambda t: F.struct(t.pos.alias("pos"), t.text.alias("text"))))
    known = F.filter("ts", lambda t: t.confidence.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, t: a + t.confidence), F.size(known))
    body = layout.gathered(tokens, "pos", "text", "confidence").select("doc_id", "page_num", F.array_join(F.transform(words, lambda t: t.text), " ").alias("Text"), F.round(mean + 1e-9, 6).alias("Confidence"))
    return body.select("doc_id", "page_num", F.to_xml(F.struct(F.col("page_num").alias("Number"), "Text", "Confidence"), {"rowTag": "Page"}).alias("xml"))


def padded(cells: DataFrame) -> DataFrame:
    """Rows of tables as text: each column as wide as its longest cell and two blanks more.

    cells: one a row, or gathered by table as the array `cells` (row_num, column_num, cell_text), which nothing is shuffled for.
    """
    if "cells" in cells.columns:
        sized = F.sort_array(F.transform("cells", lambda c: F.struct(c.column_num.alias("column_num"), F.length(c.cell_text).alias("size"))))
        widest = layout._let(sized, lambda xs: F.transform(layout._runs(xs, lambda c: c.column_num), lambda run: F.struct(F.get(run, F.lit(0)).column_num, F.element_at(run, -1).size + 2)))
        told = lambda widths, run: F.array_join(F.transform(run, lambda c: F.rpad(c.cell_text, F.element_at(widths, c.column_num), F.lit(" "))), "")
        row = lambda widths, run: F.struct(F.get(run, F.lit(0)).row_num.alias("row_num"), told(widths, run).alias("line"))
        rows = lambda widths: layout._let(layout._fields("cells", "row_num", "column_num", "cell_text"), lambda xs: F.transform(layout._runs(xs, lambda c: c.row_num), lambda run: row(widths, run)))
        return cells.select("doc_id", "table_num", F.inline(layout._let(F.map_from_entries(widest), rows)))
    widths = cells.groupBy("doc_id", "table_num", "column_num").agg((F.max(F.length("cell_text")) + 2).alias("width"))
    full = cells.join(widths, ["doc_id", "table_num", "column_num"])
    line = F.sort_array(F.collect_list(F.struct("column_num", F.rpad("cell_text", F.col("width"), F.lit(" ")).alias("t"))))
    return full.groupBy("doc_id", "table_num", "row_num").agg(F.array_join(F.transform(line, lambda c: c.t), "").alias("line"))


def text_report(pages: DataFrame) -> DataFrame:
    """By document the text of its pages (page_num, page_text) under headings."""
    each = F.concat(F.lit("=== Page "), F.col("page_num").cast("string"), F.lit(" ===\n"), F.col("page_text"), F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("page_num", each.alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p.t), "\n").alias("report"))


def markdown_report(summary: DataFrame) -> DataFrame:
    """By document a report of its summary (document_summary)."""
    lines = (
        ("# OCR Processing Report", ()), ("", ()), ("- **Pages Processed:** %d", ("page_count",)), ("- **Words Extracted:** %,d", ("word_count",)), ("- **Average Confidence:** %.1f%%", ("_pct",)),
        ("- **High Confidence Tokens (>90%%):** %d", ("high_count",)), ("- **Medium Confidence Tokens (70-90%%):** %d", ("medium_count",)), ("- **Low Confidence Tokens (<70%%):** %d", ("low_count",)),
    )
    return summary.withColumn("_pct", F.col("avg_confidence") * 100).select("doc_id", F.format_string("\n".join(x for x, _ in lines), *(F.col(c) for _, cs in lines for c in cs)).alias("report"))


def annotations(tokens: DataFrame) -> DataFrame:
    """Boxes to draw: colour by confidence, from red to green."""
    return tokens.select("doc_id", "page_num", "pos", "x1", "y1", "x2", "y2", scalars.colour(F.col("confidence")).alias("colour"))


def line_rows(tokens: DataFrame) -> DataFrame:
    """Tokens (page_num, line_num, position, ...) as rows of a table of words in the layout's order: by page, then y1, x1."""
    out = tokens.select("doc_id", F.col("page_num").alias("page_number"), F.col("line_num").alias("line_number"), "position", "text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "x1", "y1")
    return out.orderBy("doc_id", "page_number", "y1", "x1")


def document_totals(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """By document its pages, words and tables; both sides are counted before they are joined."""
    words = tokens.groupBy("doc_id", "page_num").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum("n").alias("word_count"))
    tables = cells.groupBy("doc_id", "page_num", "table_num").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("table_count"))
    return words.join(tables, "doc_id", "left").select("doc_id", "page_count", "word_count", F.coalesce("table_count", F.lit(0)).cast("long").alias("table_count"))


def workbook(summary: DataFrame, rows: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a workbook: summary, text, tables, and what needs review."""
    return {"Summary": summary, "Text Content": rows, "Tables": cells, "Review_Items": rows.where(F.col("confidence") < scalars.REVIEW)}


def review_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_rows"), F.count_if("needs_review").alias("rows_needing_review"))


def write(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Writes a table in any of the formats; txt takes its only string column, csv has a header."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    out = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if kind == "txt":
        out.text(path)
    elif kind == "csv":
        out.option("header", True).option("escape", '"').csv(path)
    elif kind == "xml":
        out.format("xml").option("rowTag", "row").save(path)
    else:
        out.format(kind).save(path)
