"""Tables, regions, whole documents, large groups, row errors, merges and SQL: against brute force, and their edge cases."""

import json
import random
import statistics

import pytest
import __spark_entry__
from pyspark.sql import functions as F

from foliant.functions import scalars
from foliant.operators import confidence, exports, layout, trees
from foliant.plans import functions, pipeline
from foliant.sources import tables, versions

TOKENS = "doc_id long, page_num int, pos int, text string, x1 int, y1 int, x2 int, y2 int, confidence double"


def test_grid_join_equals_the_page_join(spark):
    rng = random.Random(4)

    def box(most):
        w, h = (rng.choice([0, 1, 5, 20, 90, most]) for _ in "wh")
        x, y = rng.randrange(-50, 3000), rng.randrange(-50, 3000)
        return x, y, x + w, y + h

    tokens = [(1, 1 + i % 2, i, "w", *box(400), 0.9) for i in range(3000)]
    regions = [(1, 1 + i % 2, i, *box(70_000 if i == 5 else 900)) for i in range(1500)]
    # Equal boxes, overlaps around one half, boxes inside out and nulls.
    tokens += [(1, 1, 9000 + i, "w", 100, 100, 200, 100 + i, 0.9) for i in range(40, 60)] + [(1, 1, 9999, "w", 10, 10, 5, 20, 0.9), (1, 1, 9998, "w", None, 1, 5, 20, 0.9)]
    regions += [(1, 1, 9000, 100, 100, 200, 200), (1, 1, 9001, 100, 100, 200, 150), (1, 1, 9002, 30, 30, 20, 40), (1, 1, 9003, 30, None, 40, 40)]
    t = spark.createDataFrame(tokens, TOKENS)
    r = spark.createDataFrame(regions, "doc_id long, page_num int, region_id int, rx1 int, ry1 int, rx2 int, ry2 int")
    for least in (0.5, 0.2, 1.0):
        want = layout.in_region(t.where("x1 <= x2 and y1 <= y2"), r.where("rx1 <= rx2 and ry1 <= ry2"), least).select("pos", "region_id")
        got = layout.in_region_grid(t, r, least).select("pos", "region_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000
    assert layout.in_region_grid(t, r.limit(0)).count() == 0
    # Rows compared: a page join compares all pairs of a page, the grid those that share a cell.
    pairs = t.join(r, ["doc_id", "page_num"]).count()
    near = layout.in_region_grid(t.withColumn("confidence", F.col("confidence")), r)
    metrics = near._jdf.queryExecution().executedPlan()
    near.collect()
    assert pairs > 2_000_000 and "Cartesian" not in metrics.toString()


def test_grid_compares_few_rows(spark, monkeypatch):
    """What the join of cells makes, with the filter of corners and overlaps off: a tenth of the page join at most."""
    rng = random.Random(5)
    box = lambda side: (lambda x, y: (x, y, x + side, y + side))(rng.randrange(4000), rng.randrange(4000))
    t = spark.createDataFrame([(1, 1, i, "w", *box(20), 0.9) for i in range(2000)], TOKENS)
    r = spark.createDataFrame([(1, 1, i, *box(120)) for i in range(3000)], "doc_id long, page_num int, region_id int, rx1 int, ry1 int, rx2 int, ry2 int")
    monkeypatch.setattr(scalars, "inside", lambda a, b: F.lit(True))
    assert layout.in_region_grid(t, r).count() * 10 < 2000 * 3000


def ward(values, distance=20.0):
    groups = [[v] for v in sorted(values)]
    while len(groups) > 1:
        apart = lambda a, b: (2 * len(a) * len(b) / (len(a) + len(b))) ** 0.5 * abs(sum(a) / len(a) - sum(b) / len(b))
        d, i = min((apart(groups[i], groups[i + 1]), i) for i in range(len(groups) - 1))
        if d > distance:
            break
        groups[i : i + 2] = [groups[i] + groups[i + 1]]
    return [sum(g) / len(g) for g in groups]


def test_clustered_tables_of_the_given_pages(spark, sf):
    """Every page's table, worked out token by token."""
    region = (100, 0, 420, 60)
    pages = {}
    for r in tables.tokens(spark, sf).where("doc_id < 60").collect():
        pages.setdefault((r.doc_id, r.page_num), [])
        inside = r.x1 >= region[0] and r.y1 >= region[1] and r.x2 <= region[2] and r.y2 <= region[3]
        w, h = max(0, min(r.x2, region[2]) - max(r.x1, region[0])), max(0, min(r.y2, region[3]) - max(r.y1, region[1]))
        if inside or w * h / ((r.x2 - r.x1) * (r.y2 - r.y1) + 320 * 60 - w * h) >= 0.5:
            pages[r.doc_id, r.page_num].append(r)
    want, empty = {}, set()
    for key, ts in pages.items():
        if not ts:
            empty.add(key)
            continue
        ts.sort(key=lambda t: (t.y1, t.x1, t.pos))
        most = max(8, int(0.6 * statistics.median([t.y2 - t.y1 for t in ts])))
        centres = sorted((t.x1 + t.x2) / 2 for t in ts)
        if len(ts) >= 8:
            at = ward(centres)
        else:
            groups = [[centres[0]]]
            for c in centres[1:]:
                groups.append([c]) if c - groups[-1][-1] > max(20, 0.04 * max(1.0, centres[-1] - centres[0])) else groups[-1].append(c)
            at = [sum(g) / len(g) for g in groups]
        row, anchor = 0, None
        for t in ts:
            cy = (t.y1 + t.y2) / 2
            if anchor is None or abs(cy - anchor) > most:
                row, anchor = row + 1, cy
            column = 1 + sum((a + b) / 2 <= (t.x1 + t.x2) / 2 for a, b in zip(at, at[1:]))
            want.setdefault((*key, row, column), []).append(t)
    found = layout.table(tables.tokens(spark, sf).where("doc_id < 60"), region).collect()
    assert {(r.doc_id, r.page_num, r.row_num, r.column_num): (r.cell_text, r.token_ids, r.box) for r in found} == {
        k: (" ".join(t.text for t in ts), [t.pos for t in ts], [min(t.x1 for t in ts), min(t.y1 for t in ts), max(t.x2 for t in ts), max(t.y2 for t in ts)]) for k, ts in want.items()
    }
    whole = layout.tables(tables.tokens(spark, sf).where("doc_id < 60"), region).collect()
    assert empty and {(r.doc_id, r.page_num) for r in whole if not r.rows} == empty and all(r.needs_review and r.columns == [] for r in whole if not r.rows)


def test_tables_of_regions(spark):
    """A region with ruled lines, one without tokens, and one on a page that has none."""
    tokens = spark.createDataFrame([(1, 1, i, f"w{i}", 10 + 40 * i, 10, 30 + 40 * i, 22, 0.9) for i in range(4)], TOKENS)
    regions = [(1, 1, 1, 0, 0, 200, 50, [100.0, 20.0, 100.0]), (1, 1, 2, 500, 500, 600, 600, None), (2, 7, 3, 0, 0, 9, 9, [1.0]), (1, 1, 4, 0, 0, 200, 50, [])]
    df = spark.createDataFrame(regions, "doc_id long, page_num int, region_id long, rx1 int, ry1 int, rx2 int, ry2 int, lines array<double>")
    out = {r.region_id: r for r in layout.tables(tokens, df).collect()}
    assert out[1].col_positions == [20.0, 100.0] and out[1].columns == ["col_0", "col_1"] and [t.column_num for t in out[1].rows[0]] == [1, 2, 2, 2] and not out[1].needs_review
    assert all(out[i].rows == [] and out[i].needs_review and out[i].col_positions == [] for i in (2, 3))
    assert out[4].col_positions == [20.0, 60.0, 100.0, 140.0]
    assert layout.tables(tokens.limit(0), df).where("needs_review").count() == 4 and layout.tables(tokens, df.limit(0)).count() == 0


def test_tables_take_one_shuffle_of_tokens(spark, sf):
    t = tables.tokens(spark, sf)
    plan = layout.table(t, (100, 0, 420, 60), hierarchical=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def small_tree(spark):
    tokens = spark.createDataFrame([(1, 1, 0, 'a <"&', 0, 0, 5, 5, 0.5), (1, 1, 1, "b", 6, 0, 9, 5, 1.0), (1, 2, 0, "c", 0, 0, 5, 5, 0.25)], TOKENS)
    pages = spark.createDataFrame([(1, 1, 100, 200), (1, 2, 100, 200), (1, 3, 100, 200), (2, 1, 1, 1)], "doc_id long, page_num int, width int, height int")
    regions = spark.createDataFrame([(1, 1, 0, "form_field", "a b", 0.5, [0, 1], 0, 0, 9, 5)], "doc_id long, page_num int, region_num long, type string, region_text string, confidence double, token_ids array<int>, x1 int, y1 int, x2 int, y2 int")
    cells = spark.createDataFrame([(1, 2, 2, 1, 2, "x", 0.9, [0], [1, 2, 3, 4]), (1, 2, 2, 2, 1, "", 0.8, [], [0, 0, 9, 9]), (1, 2, 1, 1, 1, "y", 0.7, [0], [5, 5, 6, 6])], "doc_id long, page_num int, table_num long, row_num long, column_num long, cell_text string, confidence double, token_ids array<int>, box array<int>")
    return trees.document_tree(pages, tokens, regions, cells)


def test_document_tree(spark):
    tree = small_tree(spark)
    got = {r.doc_id: json.loads(r.json) for r in trees.document_json(tree).collect()}
    assert [p["page_num"] for p in got[1]["pages"]] == [1, 2, 3] and got[2]["pages"][0] == {"page_num": 1, "width": 1, "height": 1, "tokens": [], "regions": [], "tables": []}
    first, second = got[1]["pages"][:2]
    assert first["tokens"][0] == {"text": 'a <"&', "confidence": 0.5, "bbox": [0, 0, 5, 5]} and first["regions"][0]["token_ids"] == [0, 1]
    assert [(t["id"], t["bbox"]) for t in second["tables"]] == [("table_1", [5, 5, 6, 6]), ("table_2", [0, 0, 9, 9])] and "metadata" not in got[1]
    bare = json.loads(trees.document_json(tree, boxes=False, confidences=False, metadata=False, provenance=False).where("doc_id = 1").first().json)
    assert not any(x in json.dumps(bare) for x in ("bbox", "confidence", "token_ids")) and bare["pages"][1]["tables"][1]["cells"][0] == {"row": 0, "col": 1, "text": "x"}
    rows = sorted(map(tuple, trees.csv_rows(tree).collect()))
    assert rows == [(1, 1, "form_field", "a b", 0, 0, 9, 5, 0.5), (1, 2, "table_cell_table_1_r0_c0", "y", 5, 5, 6, 6, 0.7), (1, 2, "table_cell_table_2_r0_c1", "x", 1, 2, 3, 4, 0.9)]
    assert trees.csv_rows(tree, boxes=False, confidences=False).columns == ["doc_id", "page_num", "region_type", "text"]
    text = trees.text_export(tree).where("doc_id = 1").first().text
    assert text.split("\n") == ["=== Page 1 ===", "", "a b", "", "", "=== Page 2 ===", "", "Table 1:", "| y |", "", "Table 2:", "|  | x |", "|  |   |", "", "", "=== Page 3 ===", "", ""]
    assert "&lt;" not in text and 'x1="0"' not in trees.document_xml(tree, boxes=False).where("doc_id = 1").first().xml


def test_stored_rows_and_summaries(spark):
    tree = small_tree(spark)
    stored = trees.document_json(tree).unionByName(spark.createDataFrame([(8, "no json"), (9, None), (10, "{}"), (11, '{"pages": [{"page_num": 1, "regions": [{}]}]}')], "doc_id long, json string"))
    rows = trees.stored_rows(stored, provenance=True).collect()
    assert sorted((r.doc_id, r.page, r.type, r.text, r.row, r.col, r.table_id) for r in rows if r.doc_id == 1) == [(1, 1, "form_field", "a b", None, None, None), (1, 2, "table_cell", "", 2, 1, "table_2"), (1, 2, "table_cell", "x", 1, 2, "table_2"), (1, 2, "table_cell", "y", 1, 1, "table_1")]
    assert [(r.doc_id, r.type, r.text, r.confidence, r.bbox) for r in rows if r.doc_id != 1] == [(11, "text", "", 0.0, None)]
    kinds = spark.createDataFrame([(1, "pdf", None)], "doc_id long, document_type string, document_class string")
    assert {tuple(r) for r in trees.summaries(tree, kinds).collect()} == {(1, 4, 9, 3, 2, 1, "pdf", "unknown", 0.5), (2, 0, 0, 1, 0, 0, "unknown", "unknown", 0.0)}


def test_medians_of_large_groups(spark):
    rng = random.Random(6)
    values = {
        "hot": [rng.gauss(0, 1) for _ in range(5001)], "even": [rng.random() for _ in range(1000)], "same": [7.0] * 500, "two": [1.0, 2.0], "one": [3.5], None: [1.0, 5.0, 9.0],
        "wide": [10.0 ** rng.randrange(-300, 300) * rng.choice([-1, 1]) for _ in range(301)], "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0], "third": [4.0] * 400 + [rng.random() for _ in range(601)],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("none", float("nan")), ("two", float("nan")), ("two", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r["median"] for r in confidence.medians(df, "k", value="v").collect()}
    assert got == {k: pytest.approx(statistics.median(vs), rel=1e-12) for k, vs in values.items()}
    assert [r["median"] for r in confidence.medians(df.where("k = 'hot'"), value="v").collect()] == [statistics.median(values["hot"])]
    assert confidence.medians(df.limit(0), "k", value="v").collect() == []
    clean = df.where("v is null or abs(v) < 1000")
    names = ("n", "mean", "median", "std", "least", "most")
    want, large = ({r.k: [r[c] for c in names] for r in f(clean.where("k <> 'none'"), "k", value="v").collect()} for f in (confidence.stats, confidence.stats_of_large_groups))
    assert want.keys() == large.keys() and all(large[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items())


def test_dynamic_columns_of_json(spark):
    rows = [(1, '{"a b":1,"x`y":"q","o":{"p":1}}'), (2, '{"a b":"s","it\'s":null,"d.e":2.5,"q\\"u":"z"}'), (3, "[1]"), (4, None), (5, "no"), (6, "{}")]
    df = spark.createDataFrame(rows, "id int, columns string")
    wide, names = exports.dynamic_columns(df)
    assert names == ["a b", "d.e", "it's", "o", 'q"u', "x`y"]
    assert [tuple(r)[1:] for r in wide.orderBy("id").collect()] == [("1", "", "", '{"p":1}', "", "q"), ("s", "2.5", "", "", "z", "")] + [("",) * 6] * 4
    with pytest.raises(ValueError, match="more than 4 columns"):
        exports.dynamic_columns(df, most=4)
    assert exports.dynamic_columns(df.limit(0))[1] == [] and exports.dynamic_columns(df, ["zz"])[0].columns == ["id", "zz"]


def test_row_errors(spark):
    rows = [(1, " ok ", 0, 0, 5, 5, "0.5"), (2, " ", 9, 9, 0, 0, "x"), (3, "t", 9, 0, 0, 5, "x"), (4, "t", 0, 0, 5, 5, "x"), (5, "t", 0, 0, 5, 5, "2"), (6, "t", 0, 0, 5, None, "1"), (7, None, 0, 0, 5, 5, "1"), (8, "t", 0, 0, 5, 5, None)]
    df = spark.createDataFrame(rows, "id int, text string, x1 int, y1 int, x2 int, y2 int, confidence string")
    out = pipeline.run_rows(df, pipeline.RAW_TOKENS)
    assert {r.id: (r.step, r.reason, r.text) for r in pipeline.set_aside(out).collect()} == {
        2: ("tokens.text", "no text", " "), 3: ("tokens.box", "box is inside out", "t"), 4: ("tokens.number", "confidence is no number", "t"), 5: ("tokens.range", "confidence out of range", "t"),
        6: ("tokens.box", "no box", "t"), 7: ("tokens.text", "no text", None), 8: ("tokens.number", "no confidence", "t"),
    }
    assert [(r.id, r.text, r.score, r.needs_review) for r in pipeline.passed(out).collect()] == [(1, "ok", 0.5, True)]
    narrow = pipeline.run_rows(df, [pipeline.Step("tokens.number"), pipeline.Step("tokens.range", {"least": 0.9}), pipeline.Step("tokens.review", {"least": 0.99})])
    assert {r.id for r in pipeline.passed(narrow).collect()} == {6, 7} and pipeline.run_rows(df, []).where("error is null").count() == 8
    with pytest.raises(KeyError):
        pipeline.run_rows(df, [pipeline.Step("tokens.none")])
    # However many steps, the plan grows with them, not with their powers.
    assert len(pipeline.run_rows(df, pipeline.RAW_TOKENS * 4)._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def state(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_merges(spark, tmp_path):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    table.create(spark.createDataFrame([(i, f"a{i}", 0) for i in range(50)] + [(None, "none", 0)], "id int, text string, n int"), ["id"], buckets=8)
    before = state(table)
    files = lambda: {p for p in (tmp_path / "t/data").rglob("*.parquet")}
    old = files()
    update = spark.createDataFrame([(3, "b3", 1), (3, "c3", 2), (99, "new", 1), (None, "some", 1)], "id int, text string, at int")
    last = update.groupBy("id").agg(F.max_by("text", "at").alias("text"))
    assert table.merge(last) == 1
    want = sorted([x for x in before if x[0] not in (3, None)] + [(3, "c3", 0), (99, "new", None), (None, "some", 0)], key=str)
    assert state(table) == want and state(table, 0) == before
    # Of eight buckets, those of three keys at most were written.
    assert len({p.parent.name for p in files() - old}) <= 3 and old <= files()
    assert table.merge(update.limit(0).select("id", "text")) == 1 and table.merge(last) == 2 and state(table) == want
    assert table.merge(spark.createDataFrame([(3, 5, 1), (3, 6, 2), (3, 4, 0)], "id int, n int, at int").drop("at"), order=F.col("n")) == 3
    assert [x for x in state(table) if x[0] == 3] == [(3, "c3", 6)]
    with pytest.raises(ValueError):
        table.merge(update)
    # Two merges of one version: the second finds the first one's.
    with pytest.raises(versions.Conflict):
        table._commit(3, table._load(3))
    assert table.versions() == [0, 1, 2, 3]


def test_sql_functions(spark, sf):
    functions.register(spark)
    tables.tokens(spark, sf).where("doc_id < 30").createOrReplaceTempView("some_tokens")
    assert sorted(map(tuple, spark.sql("SELECT * FROM lines(TABLE(some_tokens))").collect())) == sorted(map(tuple, layout.lines(tables.tokens(spark, sf).where("doc_id < 30")).collect()))
    assert spark.sql("SELECT * FROM lines(TABLE(SELECT * FROM some_tokens WHERE page_num = 2), 3)").count() >= spark.sql("SELECT * FROM lines(TABLE(SELECT * FROM some_tokens WHERE page_num = 2))").count()
    with pytest.raises(Exception, match="no column y1"):
        spark.sql("SELECT * FROM lines(TABLE(SELECT doc_id, page_num, x1, y2, pos, text FROM some_tokens))").collect()
    # Within a span of 500, the gap is 20.
    gaps = layout.gap_columns(tables.tokens(spark, sf).where("doc_id < 30 and x2 <= 500"))
    got = spark.sql("SELECT doc_id, page_num, column_num, n, round(position, 6) AS position FROM columns_by_gap(TABLE(SELECT * FROM some_tokens WHERE x2 <= 500))")
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, r.page_num, r.column_num, r.n, round(r.position, 6)) for r in gaps.collect())
    r = spark.sql("SELECT quality(0.9D) AS a, quality(0.91D) AS b, quality(0.1D) AS c, quality(NULL) AS d, iou(0, 0, 10, 10, 0, 0, 10, 5) AS e, iou(3, 3, 3, 3, 3, 3, 3, 3) AS f, shard_path('abcdef') AS g, clamped(1.5D) AS h, centre(1, 4) AS i").first()
    assert tuple(r) == ("Medium", "High", "Low", None, 0.5, 0.0, "ab/cd/abcdef", 1.0, 2.5)


@pytest.mark.parametrize("name", ["region_csv", "row_provenance"])
def test_trees_are_made_once(spark, sf, name):
    """No filter stands ahead of the rows of a tree: it would work the tree out for itself."""
    plan = __spark_entry__.queries()[name](spark, sf)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if "Filter" in line and "size(" in line]
