"""The operators on literal cases."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import scalars as s
from foliant.operators import confidence, exports, jobs, layout
from foliant.plans import pipeline
from foliant.sources import readers

TOKENS = "doc_id long, page_num int, pos int, text string, x1 int, y1 int, x2 int, y2 int, confidence double"


@pytest.fixture(scope="module")
def page(spark):
    """Three tokens in two lines."""
    return spark.createDataFrame([(1, 1, 0, "Test", 10, 10, 50, 30, 0.95), (1, 1, 1, "Document", 60, 10, 120, 30, 0.92), (1, 1, 2, "Content", 10, 40, 80, 60, 0.88)], TOKENS)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_confidences(page):
    r = confidence.stats(page).first()
    assert (r["mean"], r["median"], r["least"], r["most"]) == ((0.95 + 0.92 + 0.88) / 3, 0.92, 0.88, 0.95)
    assert {x.quality: x.n for x in confidence.buckets(page).collect()} == {"High": 2, "Medium": 1}


def test_bounds_of_quality(spark):
    f = spark.createDataFrame([(0.9,), (0.7,), (0.6999,), (0.9001,), (None,)], "confidence double")
    assert [r.q for r in f.select(s.quality(F.col("confidence")).alias("q")).collect()] == ["Medium", "Medium", "Low", "High", None]
    r = confidence.bucket_shares(f.where("confidence > 2")).first()
    assert r.high_count == 0 and r.high_pct == 0


def test_lines(page):
    assert [r.line_text for r in layout.lines(page).orderBy("line_num").collect()] == ["Test Document", "Content"]
    assert [r.line_text for r in layout.adaptive_lines(page).orderBy("line_num").collect()] == ["Test Document", "Content"]


def test_lines_hold_to_their_anchor(spark):
    """Each step is below the threshold, but the third token is too far from the first."""
    f = spark.createDataFrame([(1, 1, i, str(i), 0, y, 5, y, 0.5) for i, y in enumerate((0, 10, 20, 30))], TOKENS)
    assert [r.line_text for r in layout.lines(f).orderBy("line_num").collect()] == ["0 1", "2 3"]


def test_merged_engines(spark, page):
    other = page.withColumn("confidence", F.when(F.col("pos") == 0, 0.99).otherwise(F.col("confidence")))
    assert {r.pos: (r.confidence, r.engine) for r in layout.merged_engines(page, other).collect()} == {0: (0.99, 2), 1: (0.92, 1), 2: (0.88, 1)}


def test_boxes(spark):
    box = lambda *v: [F.lit(x) for x in v]
    assert value(spark, s.iou(box(0, 0, 10, 10), box(0, 0, 10, 10))) == 1.0 and value(spark, s.iou(box(3, 3, 3, 3), box(3, 3, 3, 3))) == 0.0
    assert value(spark, s.inside(box(0, 0, 10, 10), box(0, 0, 10, 10))) is True
    assert value(spark, s.box_of(s.polygon(*box(1, 2, 3, 4)))) == [1, 2, 3, 4]
    assert value(spark, s.raw_confidence(F.lit(-1))) == 0 and value(spark, s.clamped(F.lit(1.5))) == 1


def test_cells(spark, page):
    columns = layout.gap_columns(page)
    assert [r.position for r in columns.orderBy("column_num").collect()] == [37.5, 90.0]
    assert {r.pos: r.column_num for r in layout.cells(page, columns).collect()} == {0: 1, 1: 2, 2: 1}
    region = page.select("doc_id", "page_num").distinct().select("*", F.lit(0).alias("rx1"), F.lit(0).alias("ry1"), F.lit(130).alias("rx2"), F.lit(70).alias("ry2"))
    got = {(r.row_num, r.column_num): (r.cell_text, r.needs_review) for r in layout.table(page, region).collect()}
    assert got == {(1, 1): ("Test", False), (1, 2): ("Document", False), (2, 1): ("Content", False)}


def test_review_of_pages_without_tokens(spark, page):
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_num int")
    assert {r.page_num: (r.tokens, r.needs_review) for r in layout.needs_review(page, pages).collect()} == {1: (3, False), 2: (0, True)}


def brute_ward(values, distance):
    groups = [[v] for v in sorted(values)]
    while len(groups) > 1:
        best = min(((np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * abs(np.mean(a) - np.mean(b)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] > distance:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(float(np.mean(g)) for g in groups)


@pytest.mark.parametrize("seed", range(8))
def test_ward(seed):
    values = np.random.default_rng(seed).integers(0, 300, 40) + np.random.default_rng(seed + 99).random(40)
    assert layout.ward_positions(values) == pytest.approx(brute_ward(values, 20.0))


def test_ward_of_few():
    assert layout.ward_positions(np.array([])) == [] and layout.ward_positions(np.array([5.0])) == [5.0]


def test_rate_limit_counts_admitted_only(spark):
    f = spark.createDataFrame([(i, 1, t) for i, t in enumerate((0, 1, 2, 60, 61, 62))] + [(10, 2, 0)], "request_id long, client long, t long").select("request_id", "client", F.timestamp_seconds("t").alias("at"))
    got = {r.request_id: r.admitted for r in jobs.admitted(f, 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 10: True}


def test_eta_and_message(spark):
    f = spark.createDataFrame([("processing", 0.25, "2024-01-01 00:00:00"), ("processing", 0.0, "2024-01-01 00:00:00"), ("completed", 1.0, "2024-01-01 00:00:00"), ("failed", 0.5, None)], "status string, progress double, t string")
    f = f.select("status", "progress", F.to_timestamp("t").alias("started_at"), F.lit(1).alias("job_id"))
    out = jobs.progress(f, "2024-01-01 00:01:00").collect()
    assert [r.eta_seconds for r in out] == [180.0, None, None, None] and out[0].message == "Performing OCR extraction..." and out[3].message == "Processing failed"


def test_performance_keeps_jobs_without_results(spark):
    j = spark.createDataFrame([(1, "completed", "p", "m"), (2, "completed", "p", "m"), (3, "pending", "p", "m")], "job_id long, status string, processing_profile string, processing_mode string")
    r = spark.createDataFrame([(1, 0.5, 10.0, 3.0, 4.0), (1, 0.7, 20.0, 5.0, 6.0)], "job_id long, confidence_avg double, processing_time_ms double, word_count double, tokens_extracted double")
    row = jobs.processing_performance(j, r).first()
    assert (row.total_jobs, row.distinct_jobs, row.avg_confidence, row.avg_time_ms, row.total_words) == (3, 2, 0.6, 15.0, 8.0)


def test_caches_equal_missing_parameters(spark):
    asked = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, "b", None)], "id long, h string, m int")
    stored = spark.createDataFrame([("a", None)], "h string, m int")
    assert [r.id for r in jobs.cache_hits(asked, stored, ["h", "m"]).collect()] == [1]
    assert sorted(r.id for r in jobs.cache_misses(asked, stored, ["h", "m"]).collect()) == [2, 3]


def test_pages_of_lists(spark):
    f = spark.range(10)
    assert [r.id for r in jobs.page_of(f, [F.desc("id")], 2, 3).collect()] == [7, 6, 5]
    with pytest.raises(ValueError):
        jobs.page_of(f, [F.col("id")], 0, 101)


def test_flat_rows_and_dynamic_columns(spark):
    regions = spark.createDataFrame([(1, 1, "t", 0.5, 3, 4)], "doc_id long, page_num int, region_text string, confidence double, x1 int, y1 int")
    cells = spark.createDataFrame([(1, 1, "c", 1, 1, 1), (1, 1, " ", 1, 1, 2)], "doc_id long, page_num int, cell_text string, table_num int, row_num int, column_num int")
    out = exports.flat_rows(regions, cells).collect()
    assert [(r.type, r.x, r.table) for r in out] == [("text", 3, None), ("table_cell", None, 1)]
    rows = spark.createDataFrame([("r0", {"a": "1"}), ("r1", {"b": "2", "a": "3"})], "row_id string, columns map<string,string>")
    wide, keys = exports.dynamic_columns(rows)
    assert keys == ["a", "b"] and sorted(map(tuple, wide.collect())) == [("r0", "1", ""), ("r1", "3", "2")]


def test_nested_exports(spark, page):
    import json

    got = json.loads(exports.page_json(page).first().json)
    assert got["id"] == 1 and got["pages"][0]["tokens"][0] == {"text": "Test", "bbox": [10, 10, 50, 30], "confidence": 0.95}
    assert "confidence" not in json.loads(exports.page_json(page, confidences=False).first().json)["pages"][0]["tokens"][0]
    assert "<Text>Test Document Content</Text>" in exports.page_xml(page).first().xml
    assert exports.text_report(layout.page_text(page)).first().report == "=== Page 1 ===\nTest Document Content\n"


@pytest.mark.parametrize("kind", exports.FORMATS)
def test_writes(spark, tmp_path, kind):
    frame = spark.createDataFrame([("a, \"b\"",), ("c",)], "text string")
    exports.write(frame, f"{tmp_path}/{kind}", kind)
    read = {"txt": lambda p: spark.read.text(p).toDF("text"), "csv": lambda p: spark.read.option("header", True).option("escape", '"').csv(p), "xml": lambda p: spark.read.format("xml").option("rowTag", "row").load(p)}
    got = read.get(kind, lambda p: spark.read.format(kind).load(p))(f"{tmp_path}/{kind}")
    assert sorted(r.text for r in got.collect()) == ["a, \"b\"", "c"]


def test_write_of_unknown_kinds(spark, tmp_path):
    with pytest.raises(ValueError):
        exports.write(spark.range(1), f"{tmp_path}/x", "pdf")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "c").write_bytes(b"%PDF-1.7")
    (tmp_path / "d").write_bytes(b"\xff\xd8\xff\xe0")
    assert {r.path[-5:]: r.text for r in readers.texts(spark, str(tmp_path)).collect()} == {"a.txt": "é", "b.txt": "é"}
    assert {r.path[-1]: r.mime_type for r in readers.files(spark, str(tmp_path)).collect() if r.document_type == "unknown"} == {"c": "application/pdf", "d": "image/jpeg"}


def test_word_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('One')}{p('')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Two')}</w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    out = {r.path[-6:]: r for r in readers.word_documents(spark, str(tmp_path)).collect()}
    assert (out["a.docx"].text, out["a.docx"].tables) == ("One\nTwo", [[["a", "b"]]]) and out["b.docx"].text is None and "BadZipFile" in out["b.docx"].error


def test_stored_results(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"job_id": "j", "pages": [{"page_num": 1, "text_regions": [], "blocks": [{"text": "x"}]}]}')
    assert readers.results(spark, str(tmp_path)).first().any_regions[0].text == "x"


def test_recognizers(spark):
    images = spark.createDataFrame([("a", 1, bytearray(b"x y  z")), ("b", 1, bytearray(b"bad"))], "path string, page_num int, content binary")

    def make():
        class Engine:
            name = "echo"

            def words(self, content):
                if content == b"bad":
                    raise ValueError
                return [(w, 0, 0, 1, 1, c) for w, c in zip(bytes(content).decode().split(" "), (90, -1, 50), strict=False)]

        return Engine()

    assert [(r.text, r.confidence) for r in readers.recognized(images, make).where("error is null").orderBy("pos").collect()] == [("x", 0.9), ("y", 0.0)]


def test_profiles(spark, page):
    assert "rank" in pipeline.run(page, "default").columns and pipeline.build("no such profile")[0][0] == "tokens.not_blank"
    assert pipeline.run(page, "quality", overrides={"tokens.confidence": {"least": 0.9}}).count() == 2
    assert pipeline.describe()["tokens.confidence"]["params"] == {"least": 0.0, "strict": False}
    broken = page.drop("confidence")
    with pytest.raises(Exception):
        pipeline.run(broken, "default").count()
    assert pipeline.run(broken, "default", on_error="skip").first().skipped == ["tokens.review"]


def test_cleaning(spark):
    assert value(spark, s.normalized(F.lit("exam-\nple  “x”\t–"))) == 'example "x" -'
    assert value(spark, s.masked(F.lit("a.b@c.org 4111 1111 1111 1111 +49 30 1234567"))) == "[email] [card] [phone]"
    assert value(spark, s.valid_date(F.lit("2024-02-30"))) is False and value(spark, s.valid_amount(F.lit("$1,234.50"))) is True
    assert value(spark, s.mode(F.lit(" basic "))) == "BASIC" and value(spark, s.mode(F.lit("fast"))) == "STANDARD"
    r = value(spark, s.mode_settings(F.lit("basic"), F.lit(None).cast("int"), F.lit(True)))
    assert (r.fast, r.max_pages, r.extract_tables) == (True, 3, False)
    assert value(spark, s.rejection(F.lit("a/b"), F.lit(1), F.lit("image/png"))) == "name not allowed" and value(spark, s.rejection(F.lit("a.png"), F.lit(1), F.lit("image/png"))) is None


def test_table_rows_by_the_first_token(spark):
    """Tokens 12 high, each 9 below the one before: rows of their own, as 9 is more than the threshold of 8."""
    rows = [(1, 1, i, f"w{i}", 10, 9 * i, 30, 9 * i + 12, 0.9 if i else 0.5) for i in range(6)]
    tokens = spark.createDataFrame(rows, "doc_id long, page_num int, pos int, text string, x1 int, y1 int, x2 int, y2 int, confidence double")
    for hierarchical in (False, True):
        out = layout.table(tokens, (0, 0, 100, 100), hierarchical=hierarchical).collect()
        assert sorted((r.row_num, r.column_num, r.cell_text) for r in out) == [(i + 1, 1, f"w{i}") for i in range(6)]
        # One token of low confidence marks the whole table.
        assert all(r.needs_review for r in out)
    regions = spark.createDataFrame([(1, 1, 0, 0, 100, 30)], "doc_id long, page_num int, rx1 int, ry1 int, rx2 int, ry2 int")
    assert layout.table(tokens, regions).count() == 3


def test_table_columns_clustered(spark):
    """Centres 15 apart are one column by gaps of 20; clustering may part them, and keeps every word."""
    rows = [(1, 1, i, f"w{i}", x, 20 * (i // 4), x + 10, 20 * (i // 4) + 12, 0.9) for i, x in enumerate([0, 15, 80, 95] * 2)]
    tokens = spark.createDataFrame(rows, "doc_id long, page_num int, pos int, text string, x1 int, y1 int, x2 int, y2 int, confidence double")
    by_gaps = {(r.row_num, r.column_num): r.cell_text for r in layout.table(tokens, (0, 0, 200, 100), hierarchical=False).collect()}
    clustered = {(r.row_num, r.column_num): r.cell_text for r in layout.table(tokens, (0, 0, 200, 100)).collect()}
    assert by_gaps == {(1, 1): "w0 w1", (1, 2): "w2 w3", (2, 1): "w4 w5", (2, 2): "w6 w7"}
    assert sorted(" ".join(clustered[k] for k in sorted(clustered)).split()) == [f"w{i}" for i in range(8)]


def test_results_of_recognizers(spark):
    rows = [
        (1, '[{"rec_texts": ["a", "b", "c", "d"], "rec_scores": [0.9, null], "rec_polys": [[[1.7, 2.2], [9, 2], [9, 8.9], [1, 8]], [[1, 1]], []]}]'),
        (2, '[[[[[3, 4], [5, 4], [5, 6], [3, 6]], ["x, \\"y\\"", 0.5]], [[[0, 0], [1, 1]], ["bad", "no number"]], "junk", [[[0, 0], [2, 3]], ["z", 1]]]]'),
        (3, "[]"), (4, None), (5, "no json"),
    ]
    out = {(r.id, r.pos): (r.text, r.bbox, r.confidence) for r in readers.result_tokens(spark.createDataFrame(rows, "id int, result string")).collect()}
    # The second word's score is null and the third's polygon has no points: both are left out.
    assert out == {(1, 0): ("a", [1, 2, 9, 8], 0.9), (1, 3): ("d", [0, 0, 0, 0], 0.0), (2, 0): ('x, "y"', [3, 4, 5, 6], 0.5), (2, 3): ("z", [0, 0, 2, 3], 1.0)}


def test_defaults_and_sheets(spark):
    assert value(spark, s.percent(F.lit(0.9123))) == "91.2%" and value(spark, s.percent(F.lit(1.0))) == "100.0%"
    assert value(spark, confidence.or_default(F.lit(None).cast("double"), 1.0)) == 1.0 and value(spark, confidence.or_default(F.lit(0.4), 1.0)) == 0.4
    assert [value(spark, confidence.job_confidence(F.lit(x).cast("double"))) for x in (0.0, None, 0.3)] == [0.9, 0.9, 0.3]
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", None)], "text string, confidence double")
    sheets = exports.workbook(rows.limit(1), rows, rows.limit(0))
    assert list(sheets) == ["Summary", "Text Content", "Tables", "Review_Items"] and [r.text for r in sheets["Review_Items"].collect()] == ["a"]


def test_configurations(spark, page):
    again = pipeline.from_config(pipeline.to_config())
    assert {k: list(v) for k, v in again.items()} == {k: list(v) for k, v in pipeline.PROFILES.items()}
    assert pipeline.run(page, "quality", profiles=again | {"default": ()}).count() == pipeline.run(page, "quality").count()
    assert all(pipeline.from_config(x) == {} for x in (None, "", "no json", "[]", '{"pipelines": {"a": {"processors": [{}]}}}', '{"pipelines": 3}'))
    with pytest.raises(KeyError, match="tokens.none"):
        pipeline.from_config('{"pipelines": {"a": {"processors": [{"id": "tokens.none"}]}}}')


def test_modes_and_errors(spark):
    none = F.lit(None)
    flags = lambda name, *asked: tuple(value(spark, s.mode_flags(F.lit(name), *(F.lit(x) for x in asked))))
    assert flags("basic", False, None, True, True, True, True) == ("BASIC", True, 3, False, False, False, False)
    assert flags("ADVANCED", None, 7, None, True, True, True) == ("ADVANCED", False, 7, True, False, False, False)
    assert flags(None, True, None, None, True, None, True) == ("STANDARD", True, None, False, True, False, True)
    r = value(spark, s.error_response(F.lit("RateLimitException"), none.cast("string"), F.lit("7")))
    assert r.status_code == 429 and r.body == '{"error":{"type":"RateLimitException","message":"Rate limit exceeded"},"request_id":"7"}'
    assert value(spark, s.error_response(F.lit("odd"), F.lit("x"), none.cast("string"))).body == '{"error":{"type":"InternalServerError","message":"An unexpected error occurred","details":{"error":"x"}}}'
