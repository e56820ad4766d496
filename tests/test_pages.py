"""Queries of whole pages and documents move text, not tokens."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliant.functions import scalars
from foliant.operators import layout, trees
from foliant.plans import documents
from foliant.sources import readers, tables

QUERIES = (
    "recognizer_results ruled_table_cells document_json_bare document_json document_xml region_tokens region_csv result_summary row_provenance stored_result_rows text_export ensemble_dedup page_json page_tables table_cells "
    "table_cells_clustered csv_union_export extracted_rows_min_conf line_word_rows line_groups_fixed review_totals reading_order_topk padded_tables page_xml text_report page_text document_text ward_columns"
).split()


@pytest.mark.parametrize("name", QUERIES)
def test_only_texts_are_shuffled(spark, sf, name):
    """By document only, as its texts are: tokens were shuffled by page, and by what came of pages."""
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert shuffles and all(re.fullmatch(r"doc_id#\d+L", by) for by in shuffles)


def test_pages_are_the_tokens_by_page(spark):
    docs = [(1, "a b\n\nc  d e"), (2, "\n \n"), (3, None), (4, "x\ny"), (4, "z\n\nw"), (5, "")]
    texts = spark.createDataFrame(docs, "doc_id long, text string").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    pages = {(r.doc_id, p.page_num): sorted(t.text for t in p.ts) for r in tables.paged(texts).collect() for p in r.pages}
    assert pages == {(1, 1): ["a", "b"], (1, 3): ["c", "d", "e"], (4, 1): ["x", "z"], (4, 2): ["y"], (4, 3): ["w"]}


def test_token_pages_are_tokens(spark, sf):
    t = tables.tokens(spark, sf)
    got = tables.token_pages(spark, sf).select("doc_id", "page_num", F.inline("ts")).select(t.columns)
    assert got.count() == t.count() and got.exceptAll(t).count() == 0


def test_page_regions_are_those_of_the_grid(spark):
    rows = [(1, 1, i, f"w{i}", (i * 37) % 400 - (i % 50 == 0) * 30, (i * 53) % 900, (i * 37) % 400 + i % 60, (i * 53) % 900 + 5 + i % 90 - (i % 41 == 0) * 20, 0.5) for i in range(400)]
    t = spark.createDataFrame(rows, "doc_id long, page_num int, pos int, text string, x1 int, y1 int, x2 int, y2 int, confidence double")
    boxes = [(1, 1, i, (i * 29) % 380 - 5, (i * 71) % 880, (i * 29) % 380 + 20 + i % 70, (i * 71) % 880 + 8 + i % 120 - (i % 17 == 0) * 30) for i in range(150)]
    r = spark.createDataFrame(boxes, "doc_id long, page_num int, region_id long, rx1 int, ry1 int, rx2 int, ry2 int")
    want = {(x.pos, x.region_id) for x in layout.in_region_grid(t, r).collect()}
    pages = layout.gathered(t, *t.columns[2:]).join(r.groupBy("doc_id", "page_num").agg(F.collect_list(F.struct("region_id", "rx1", "ry1", "rx2", "ry2")).alias("regions")), ["doc_id", "page_num"])
    found = layout.in_page_regions(pages).collect()
    assert {(x.pos, f.region_id) for f in found for x in f.ts} == want and want and len(found) == 150


def test_results_that_are_read_in_one_pass(spark):
    rows = [(1, '[{"rec_texts": ["a", "b"], "rec_scores": [0.5], "rec_polys": [[[1, 2], [3, 4]]]}]'), (2, '[[[[[1, 2], [3, 4]], ["c", 0.25]], [[[1, 2]], ["d", "no"]], "x"]]'), (3, "none"), (4, None)]
    got = sorted(map(tuple, readers.result_tokens(spark.createDataFrame(rows, "id long, result string")).collect()))
    assert got == [(1, 0, "a", [1, 2, 3, 4], 0.5), (1, 1, "b", [0, 0, 0, 0], 0.0), (2, 0, "c", [1, 2, 3, 4], 0.25)]


def test_lines_in_sql_are_made_from_pages(spark, sf):
    """No Python row for each token and no shuffle of tokens; the lines are those of the operator, by any threshold."""
    plan = entry.queries()["sql_lines"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and re.findall(r"Exchange hashpartitioning\((\w+)", plan) == ["doc_id"]
    tables.token_pages(spark, sf).createOrReplaceTempView("some_pages")
    for threshold in (0, 3, 12):
        got = spark.sql(f"SELECT doc_id, page_num, inline_outer(ls) FROM (SELECT doc_id, page_num, lines_of(ts, {threshold}D) AS ls FROM some_pages)")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, layout.lines(tables.token_pages(spark, sf), threshold).collect()))


@pytest.mark.parametrize("name", ["document_json_bare", "document_json", "document_xml", "page_json"])
def test_texts_stay_where_they_are_read(spark, sf, tmp_path, name):
    """Of files with a part for each core and one row for each doc_id nothing is shuffled; where a doc_id stands twice its texts are one document, as in the file that is shuffled."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    shuffles = []
    for again in (0, 3):
        rows = docs.union(docs.where("doc_id < 4").withColumn("text", F.concat(F.lit("once more\n"), "text")).limit(again))
        for kind, n in (("parts", 8), ("whole", 1)):
            rows.repartition(n).write.parquet(str(tmp_path / f"{kind}{again}" / "documents.parquet"))
        of = {kind: entry.queries()[name](spark, str(tmp_path / f"{kind}{again}")) for kind in ("parts", "whole")}
        shuffles.append({kind: "Exchange" in df._jdf.queryExecution().executedPlan().toString() for kind, df in of.items()})
        assert sorted(map(str, of["parts"].collect())) == sorted(map(str, of["whole"].collect()))
    assert shuffles == [{"parts": False, "whole": True}, {"parts": True, "whole": True}]


def test_trees_are_made_without_what_is_left_out(spark, sf):
    """The bare documents were made whole and then rebuilt; made bare at once they are the same."""
    off = {"boxes": False, "confidences": False, "metadata": False, "provenance": False}
    whole, bare = documents.tree(spark, sf), documents.tree(spark, sf, trees.left_out(**off))
    assert not any(trees.has(bare.schema["document"].dataType, name) for name in ("bbox", "confidence", "metadata", "token_ids"))
    want, got = (sorted(map(tuple, trees.document_json(t, **off).collect())) for t in (whole, bare))
    assert got == want and len(got) > 100


def test_tokens_in_a_box_are_those_by_all_areas(spark):
    """Tokens beside the box, that touch it, hold it, stand in it, have no area or are inside out."""
    edges = [(a, b) for a in (80, 100, 260, 420, 440) for b in (80, 100, 260, 420, 440)]
    rows = [(1, 1, i, "w", x1, y1, x2, y2, 0.5) for i, ((x1, x2), (y1, y2)) in enumerate((x, y) for x in edges for y in ((-10, 0), (0, 0), (0, 60), (10, 80), (60, 90), (50, 20), (70, 80)))]
    t = spark.createDataFrame(rows, "doc_id long, page_num int, pos int, text string, x1 int, y1 int, x2 int, y2 int, confidence double")
    box = [F.lit(v) for v in (100, 0, 420, 60)]
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    want = {r.pos for r in t.where(scalars.inside(b, box) | (scalars.iou(b, box) >= 0.5)).collect()}
    got = layout.gathered(t, *t.columns[2:]).select(layout.in_box_of("ts", (100, 0, 420, 60)).alias("ts")).first().ts
    assert {x.pos for x in got} == want and 0 < len(want) < len(rows)
