"""The registered queries and the SQL (DuckDB) that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import scalars
from foliant.operators import confidence, exports, jobs, layout
from foliant.plans import pipeline
from foliant.sources import readers, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The projections of foliant.sources.tables, in SQL.
LINES = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents)"""
TOKENS = rf"""{LINES},
line_words AS (SELECT doc_id, ln, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS ws FROM lines),
raw AS (SELECT doc_id, ln, unnest(ws) AS text, unnest(range(len(ws))) AS pos FROM line_words),
tokens AS (SELECT doc_id, ln + 1 AS page_num, pos, text, (pos * 40) % 600 AS x1, (pos // 15) * 18 + pos % 3 AS y1, (pos * 40) % 600 + length(text) * 7 AS x2,
  (pos // 15) * 18 + pos % 3 + 12 AS y2, ((doc_id * 31 + ln * 17 + pos * 13) % 101) / 100.0::DOUBLE AS confidence FROM raw)"""
JOBS = """jobs AS (SELECT *, CASE WHEN status = 'completed' THEN started_at + to_seconds(30 + job_id % 600) END AS completed_at FROM (
  SELECT *, CASE WHEN status <> 'pending' THEN created_at + to_seconds(job_id % 60) END AS started_at FROM (
    SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status, o_orderdate AS created_at, o_totalprice AS document_size,
      o_orderpriority AS processing_profile, ['basic', 'standard', 'advanced'][o_custkey % 3 + 1] AS processing_mode,
      CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN (o_orderkey % 100) / 100.0 ELSE 0.0 END::DOUBLE AS progress FROM orders)))"""
RESULTS = "results AS (SELECT l_orderkey AS job_id, l_linenumber AS page_number, l_quantity AS word_count, l_quantity + l_linenumber AS tokens_extracted, 1 - l_discount AS confidence_avg, l_extendedprice AS processing_time_ms FROM lineitem)"
REQUESTS = "requests AS (SELECT event_id AS request_id, user_id AS client, ts AS \"at\", event_type AS endpoint, value / 1000 AS duration_s, value AS metric_value, props AS metadata FROM events)"
FILES = r"files AS (SELECT page_id AS file_id, regexp_replace(url, '[?#].*$', '') AS path, html AS content FROM pages)"
QUALITY = "CASE WHEN confidence > 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium' WHEN confidence < 0.7 THEN 'Low' END"
#: The second day of all whose jobs are looked at, and the instant at which jobs are asked for.
AS_OF, NOW = "2001-08-01", "2001-08-01 12:00:00"
#: A table's region on every page of the fixture.
REGION = (100, 0, 420, 60)


def rounded(c: Column) -> Column:
    """For the comparison with SQL: the order of summation is the engine's, so figures are told to 6 places, and halves (less what sums lose) go up."""
    return F.round(c + 1e-9, 6)


def told(df: DataFrame, *columns: str, **places: int) -> DataFrame:
    """df with figures rounded: columns by `rounded`, others to so many places."""
    return df.withColumns({c: rounded(F.col(c)) for c in columns} | {c: F.round(c, n) for c, n in places.items()})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _regions(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "page_num").distinct().select("doc_id", "page_num", *(F.lit(v).alias(c) for c, v in zip(("rx1", "ry1", "rx2", "ry2"), REGION, strict=True)))


# Summaries and confidences.


@query(
    "doc_summary",
    rf"""WITH {TOKENS}, sizes AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS word_count, length(text)::BIGINT AS char_count, len(string_split(text, chr(10)))::BIGINT AS page_count FROM documents),
found AS (SELECT doc_id, round(avg(confidence) + 1e-9, 6) AS a, round(median(confidence) + 1e-9, 6) AS m, round(stddev_pop(confidence) + 1e-9, 6) AS s, min(confidence) AS lo, max(confidence) AS hi,
  count(*) FILTER (confidence > 0.9) AS h, count(*) FILTER (confidence BETWEEN 0.7 AND 0.9) AS d, count(*) FILTER (confidence < 0.7) AS l FROM tokens GROUP BY doc_id)
SELECT doc_id, page_count, word_count, char_count, coalesce(a, 0) AS avg_confidence, coalesce(m, 0) AS median_confidence, coalesce(s, 0) AS std_confidence, coalesce(lo, 0) AS min_confidence, coalesce(hi, 0) AS max_confidence,
  coalesce(h, 0) AS high_count, coalesce(d, 0) AS medium_count, coalesce(l, 0) AS low_count FROM sizes LEFT JOIN found USING (doc_id)""",
)
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(confidence.document_summary(tables.table(spark, sf_dir, "documents"), tables.tokens(spark, sf_dir)), "avg_confidence", "median_confidence", "std_confidence")


@query(
    "doc_confidence_stats",
    f"""WITH {TOKENS} SELECT doc_id, count(*) AS n, round(avg(confidence) + 1e-9, 6) AS mean, round(median(confidence) + 1e-9, 6) AS median, round(stddev_pop(confidence) + 1e-9, 6) AS std, min(confidence) AS least, max(confidence) AS most FROM tokens GROUP BY doc_id""",
)
def doc_confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(confidence.stats(tables.tokens(spark, sf_dir), "doc_id"), "mean", "median", "std")


@query("quality_buckets", f"WITH {TOKENS} SELECT doc_id, {QUALITY} AS quality, count(*) AS n FROM tokens GROUP BY ALL")
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.buckets(tables.tokens(spark, sf_dir), "doc_id")


@query(
    "quality_pct",
    f"""WITH {TOKENS}, q AS (SELECT count(*) FILTER (confidence > 0.9) AS h, count(*) FILTER (confidence BETWEEN 0.7 AND 0.9) AS m, count(*) FILTER (confidence < 0.7) AS l, count(*) AS n FROM tokens)
SELECT h AS high_count, round(h / n * 100 + 1e-9, 6) AS high_pct, m AS medium_count, round(m / n * 100 + 1e-9, 6) AS medium_pct, l AS low_count, round(l / n * 100 + 1e-9, 6) AS low_pct FROM q""",
)
def quality_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(confidence.bucket_shares(tables.tokens(spark, sf_dir)), "high_pct", "medium_pct", "low_pct")


@query("confidence_hist20", f"WITH {TOKENS} SELECT least(floor(confidence * 20), 19)::BIGINT AS bin, count(*) AS n FROM tokens GROUP BY 1")
def confidence_hist20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.histogram(tables.tokens(spark, sf_dir), F.col("confidence"), 20, 0.0, 1.0)


@query("token_length_hist", f"WITH {TOKENS} SELECT least(floor(length(text) / 40.0::DOUBLE * 20), 19)::BIGINT AS bin, count(*) AS n FROM tokens GROUP BY 1")
def token_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.histogram(tables.tokens(spark, sf_dir), F.length("text"), 20, 0.0, 40.0)


@query(
    "macro_vs_micro_confidence",
    f"""WITH {TOKENS}, d AS (SELECT doc_id, avg(confidence) AS mean, sum(confidence) AS total, count(*) AS n FROM tokens GROUP BY doc_id)
SELECT count(*) AS documents, sum(n)::BIGINT AS tokens, round(avg(mean) + 1e-9, 6) AS macro, round(sum(total) / sum(n) + 1e-9, 6) AS micro FROM d""",
)
def macro_vs_micro_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(confidence.macro_and_micro(tables.tokens(spark, sf_dir)), "macro", "micro")


@query(
    "document_records",
    f"""WITH {TOKENS} SELECT doc_id, count(*) AS word_count, count(DISTINCT page_num) AS page_count, round(avg(confidence) + 1e-9, 6) AS avg_confidence, 'Document ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' with a name that is far too long' END AS name,
  CASE WHEN length(name) > 30 THEN substr(name, 1, 30) || '...' ELSE name END AS short_name FROM tokens GROUP BY doc_id""",
)
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = tables.tokens(spark, sf_dir).groupBy("doc_id", "page_num").agg(F.count("*").alias("n"), F.sum("confidence").alias("c")).groupBy("doc_id")
    found = by.agg(F.sum("n").alias("word_count"), F.count("*").alias("page_count"), rounded(F.sum("c") / F.sum("n")).alias("avg_confidence"))
    name = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(" with a name that is far too long"))
    return found.withColumn("name", name).withColumn("short_name", scalars.shortened(F.col("name")))


# Tokens, pages and layout.


@query("page_text", f"WITH {TOKENS} SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY pos) AS page_text FROM tokens GROUP BY ALL")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_text(tables.token_pages(spark, sf_dir))


@query("document_text", f"WITH {TOKENS} SELECT doc_id, string_agg(text, ' ' ORDER BY page_num, pos) AS document_text FROM tokens GROUP BY ALL")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.document_text(tables.token_pages(spark, sf_dir))


@query("token_filter_page", f"WITH {TOKENS} SELECT doc_id, page_num, pos, text, confidence FROM tokens WHERE confidence >= 0.8 AND page_num = 2")
def token_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tokens(spark, sf_dir).where("confidence >= 0.8 and page_num = 2").select("doc_id", "page_num", "pos", "text", "confidence")


@query(
    "token_dims",
    f"""WITH {TOKENS} SELECT doc_id, page_num, pos, x2 - x1 AS width, y2 - y1 AS height, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy, round(1 - greatest(0, least(1, confidence)), 6) AS red, greatest(0, least(1, confidence)) AS green FROM tokens""",
)
def token_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = tables.tokens(spark, sf_dir), scalars.colour(F.col("confidence"))
    return t.select(
        "doc_id", "page_num", "pos", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), scalars.centre(F.col("x1"), F.col("x2")).alias("cx"), scalars.centre(F.col("y1"), F.col("y2")).alias("cy"),
        F.round(c["r"], 6).alias("red"), c["g"].alias("green"),
    )


@query("reading_order_topk", f"WITH {TOKENS} SELECT * FROM (SELECT doc_id, page_num, pos, text, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y1, x1, pos) AS rank FROM tokens) WHERE rank <= 20")
def reading_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(tables.token_pages(spark, sf_dir)).where("rank <= 20").select("doc_id", "page_num", "pos", "text", "rank")


@query(
    "ensemble_dedup",
    f"""WITH {TOKENS}, every AS (SELECT *, 1 AS engine FROM tokens UNION ALL SELECT doc_id, page_num, pos, text, x1, y1, x2, y2, ((doc_id * 7 + (page_num - 1) * 5 + pos * 11) % 101) / 100.0::DOUBLE, 2 FROM tokens WHERE pos % 2 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, text, x1, y1, x2, y2 ORDER BY confidence DESC, engine, pos DESC) AS r FROM every)
SELECT doc_id, page_num, pos, text, x1, y1, x2, y2, confidence, engine FROM ranked WHERE r = 1""",
)
def ensemble_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.best_of_engines(tables.both_engines(tables.token_pages(spark, sf_dir)))


_FOLD = """folded AS (SELECT doc_id, page_num, list_reduce(list_prepend({{'anchor': -1e9::DOUBLE, 'line': 0, 'of': []::INT[]}}, list(struct_pack(anchor := (y1 + y2) / 2.0::DOUBLE, line := 0, of := []::INT[]) ORDER BY y1, x1, pos)),
  lambda a, t: CASE WHEN a.anchor < -1e8 OR abs(t.anchor - a.anchor) > {most} THEN struct_pack(anchor := t.anchor, line := a.line + 1, of := list_append(a.of, a.line + 1)) ELSE struct_pack(anchor := a.anchor, line := a.line, of := list_append(a.of, a.line)) END).of AS lines,
  list(text ORDER BY y1, x1, pos) AS texts, list(y1 ORDER BY y1, x1, pos) AS ys FROM {source} GROUP BY doc_id, page_num{more}),
each AS (SELECT doc_id, page_num, unnest(lines) AS line_num, unnest(texts) AS text, unnest(ys) AS y1, unnest(range(len(lines))) AS i FROM folded)
SELECT doc_id, page_num, line_num::BIGINT AS line_num, count(*) AS n, min(y1) AS y, string_agg(text, ' ' ORDER BY i) AS line_text FROM each GROUP BY ALL"""


@query("line_groups_fixed", f"WITH {TOKENS}, " + _FOLD.format(most="12", source="tokens", more=""))
def line_groups_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(tables.token_pages(spark, sf_dir))


@query(
    "line_groups_adaptive",
    f"WITH {TOKENS}, heights AS (SELECT doc_id, page_num, greatest(8, floor(median(y2 - y1) * 0.6))::INT AS threshold FROM tokens GROUP BY ALL), sized AS (SELECT * FROM tokens JOIN heights USING (doc_id, page_num)), "
    + _FOLD.format(most="any_value(threshold)", source="sized", more=""),
)
def line_groups_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.adaptive_lines(tables.tokens(spark, sf_dir))


_COLUMNS = """spans AS (SELECT *, greatest(20.0, 0.04 * greatest(1.0, max(cx) OVER p - min(cx) OVER p)) AS gap, lag(cx) OVER w AS before FROM (SELECT doc_id, page_num, pos, (x1 + x2) / 2.0::DOUBLE AS cx FROM {source})
  WINDOW p AS (PARTITION BY doc_id, page_num), w AS (PARTITION BY doc_id, page_num ORDER BY cx, pos)),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR cx - before > gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num ORDER BY cx, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS column_num FROM spans),
columns AS (SELECT doc_id, page_num, column_num, count(*) AS n, round(avg(cx), 6) AS position FROM numbered GROUP BY ALL)"""


@query("gap_columns", f"WITH {TOKENS}, " + _COLUMNS.format(source="tokens") + " SELECT * FROM columns")
def gap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(layout.gap_columns(tables.tokens(spark, sf_dir)), position=6)


@query(
    "cell_assignment",
    f"WITH {TOKENS}, " + _COLUMNS.format(source="tokens").replace("round(avg(cx), 6)", "avg(cx)") + """, bounds AS (SELECT *, coalesce((lag(position) OVER w + position) / 2, '-inf'::DOUBLE) AS lo, coalesce((lead(position) OVER w + position) / 2, 'inf'::DOUBLE) AS hi FROM columns WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY position, column_num))
SELECT t.doc_id, t.page_num, t.pos, b.column_num FROM tokens t JOIN bounds b ON t.doc_id = b.doc_id AND t.page_num = b.page_num AND (x1 + x2) / 2.0::DOUBLE >= lo AND (x1 + x2) / 2.0::DOUBLE < hi""",
)
def cell_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.tokens(spark, sf_dir)
    return layout.cells(t, layout.gap_columns(t)).select("doc_id", "page_num", "pos", "column_num")


_INSIDE = """(x1 >= 100 AND y1 >= 0 AND x2 <= 420 AND y2 <= 60 OR (greatest(0, least(x2, 420) - greatest(x1, 100)) * greatest(0, least(y2, 60) - greatest(y1, 0)))::DOUBLE /
  nullif(greatest(0, x2 - x1) * greatest(0, y2 - y1) + 320 * 60 - greatest(0, least(x2, 420) - greatest(x1, 100)) * greatest(0, least(y2, 60) - greatest(y1, 0)), 0) >= 0.5)"""


@query("inside_iou", f"WITH {TOKENS} SELECT doc_id, page_num, pos FROM tokens WHERE {_INSIDE}")
def inside_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.tokens(spark, sf_dir)
    return layout.in_region(t, _regions(t)).select("doc_id", "page_num", "pos")


@query(
    "table_cells",
    f"WITH {TOKENS}, own AS (SELECT * FROM tokens WHERE {_INSIDE}), " + _COLUMNS.format(source="own").replace("round(avg(cx), 6)", "avg(cx)") + """, bounds AS (SELECT *, coalesce((lag(position) OVER w + position) / 2, '-inf'::DOUBLE) AS lo, coalesce((lead(position) OVER w + position) / 2, 'inf'::DOUBLE) AS hi FROM columns WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY position, column_num)),
placed AS (SELECT t.*, b.column_num FROM own t JOIN bounds b ON t.doc_id = b.doc_id AND t.page_num = b.page_num AND (x1 + x2) / 2.0::DOUBLE >= lo AND (x1 + x2) / 2.0::DOUBLE < hi),
heights AS (SELECT doc_id, page_num, greatest(8, floor(median(y2 - y1) * 0.6))::INT AS threshold, bool_or(confidence < 0.8) AS needs_review FROM own GROUP BY ALL),
folded AS (SELECT doc_id, page_num, list_reduce(list_prepend({'anchor': -1e9::DOUBLE, 'line': 0, 'of': []::INT[]}, list(struct_pack(anchor := (y1 + y2) / 2.0::DOUBLE, line := 0, of := []::INT[]) ORDER BY y1, x1, pos)),
  lambda a, t: CASE WHEN a.anchor < -1e8 OR abs(t.anchor - a.anchor) > any_value(threshold) THEN struct_pack(anchor := t.anchor, line := a.line + 1, of := list_append(a.of, a.line + 1)) ELSE struct_pack(anchor := a.anchor, line := a.line, of := list_append(a.of, a.line)) END).of AS lines,
  list(pos ORDER BY y1, x1, pos) AS poss FROM own JOIN heights USING (doc_id, page_num) GROUP BY doc_id, page_num),
rows AS (SELECT doc_id, page_num, unnest(lines)::BIGINT AS row_num, unnest(poss) AS pos FROM folded)
SELECT doc_id, page_num, row_num, column_num, string_agg(text, ' ' ORDER BY y1, x1, pos) AS cell_text, min(confidence) AS confidence, any_value(needs_review) AS needs_review FROM placed JOIN rows USING (doc_id, page_num, pos) JOIN heights USING (doc_id, page_num) GROUP BY ALL""",
)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table(tables.token_pages(spark, sf_dir), REGION, hierarchical=False).drop("token_ids", "box")


@query("table_cells_clustered")
def table_cells_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table(tables.token_pages(spark, sf_dir), REGION).drop("token_ids", "box")


@query(
    "needs_review_pages",
    f"""WITH {TOKENS}, found AS (SELECT doc_id, page_num, bool_or(confidence < 0.8) AS low, count(*) AS n FROM tokens GROUP BY ALL)
SELECT l.doc_id, l.ln + 1 AS page_num, coalesce(n, 0) AS tokens, coalesce(low, true) AS needs_review FROM lines l LEFT JOIN found f ON f.doc_id = l.doc_id AND f.page_num = l.ln + 1""",
)
def needs_review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).select("doc_id", (F.col("ln") + 1).alias("page_num"))
    return layout.needs_review(tables.tokens(spark, sf_dir), pages)


def _line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of 15 words of a page is a region."""
    of = lambda c: F.transform("ts", lambda t: t[c])
    mean = F.aggregate(of("confidence"), F.lit(0.0), lambda a, c: a + c) / F.size("ts")
    return tables.token_pages(spark, sf_dir).select("doc_id", "page_num", F.inline(layout.runs_of("ts"))).select(
        "doc_id", "page_num", "region_num", F.array_join(of("text"), " ").alias("region_text"), of("pos").alias("token_ids"), F.array_min(of("confidence")).alias("least_confidence"), rounded(mean).alias("confidence"), F.array_min(of("x1")).alias("x1"), F.array_min(of("y1")).alias("y1")
    )


_REGIONS = "regions AS (SELECT doc_id, page_num, pos // 15 AS region_num, string_agg(text, ' ' ORDER BY pos) AS region_text, count(*) AS n, min(confidence) AS least, round(avg(confidence) + 1e-9, 6) AS confidence, min(x1) AS x1, min(y1) AS y1 FROM tokens GROUP BY ALL)"


@query(
    "extracted_rows_min_conf",
    f"""WITH {TOKENS}, {_REGIONS} SELECT doc_id, 'row_' || (row_number() OVER (PARTITION BY doc_id ORDER BY page_num, region_num) - 1) AS row_id, page_num, region_num, region_text AS row_text, n AS tokens, least AS confidence, least < 0.8 AS needs_review FROM regions""",
)
def extracted_rows_min_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extracted_rows(_line_regions(spark, sf_dir))


@query("review_totals", f"WITH {TOKENS}, {_REGIONS} SELECT count(*) AS total_rows, count(*) FILTER (least < 0.8) AS rows_needing_review FROM regions")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.review_totals(layout.extracted_rows(_line_regions(spark, sf_dir)))


@query(
    "best_rotation",
    f"""WITH {TOKENS}, turned AS (SELECT doc_id, (pos % 4) * 90 AS degrees, round(avg(confidence), 9) AS mean, count(*) AS n FROM tokens GROUP BY ALL)
SELECT doc_id, degrees, mean, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mean DESC, n DESC, degrees) AS r FROM turned) WHERE r = 1""",
)
def best_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.best_rotation(tables.tokens(spark, sf_dir).withColumn("degrees", F.col("pos") % 4 * 90), "doc_id")


@query("ward_columns")
def ward_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(layout.ward_columns(tables.token_pages(spark, sf_dir)), position=6)


@query("profile_quality", f"WITH {TOKENS} SELECT doc_id, page_num, pos, text, confidence, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y1, x1, pos) AS rank, confidence < 0.9 AS needs_review FROM tokens WHERE trim(text) <> '' AND confidence >= 0.5")
def profile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(tables.tokens(spark, sf_dir), "quality").select("doc_id", "page_num", "pos", "text", "confidence", "rank", "needs_review")


# Jobs and results.


@query(
    "job_statistics",
    f"""WITH {JOBS} SELECT status, date_trunc('day', created_at)::TIMESTAMP AS day, count(*) AS job_count, round(avg(epoch(completed_at) - epoch(started_at)), 6) AS avg_seconds, round(avg(document_size), 4) AS avg_size
FROM jobs WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL""",
)
def job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(jobs.job_statistics(tables.jobs(spark, sf_dir), AS_OF), avg_seconds=6, avg_size=4)


@query(
    "processing_performance",
    f"""WITH {JOBS}, {RESULTS} SELECT processing_profile, processing_mode, count(j.job_id) AS total_jobs, count(DISTINCT j.job_id) AS distinct_jobs, round(avg(confidence_avg), 6) AS avg_confidence, round(avg(processing_time_ms), 4) AS avg_time_ms,
  sum(word_count) AS total_words, sum(tokens_extracted) AS total_tokens FROM jobs j LEFT JOIN results r ON j.job_id = r.job_id WHERE status = 'completed' GROUP BY ALL""",
)
def processing_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(jobs.processing_performance(tables.jobs(spark, sf_dir), tables.page_results(spark, sf_dir)), avg_confidence=6, avg_time_ms=4)


@query("job_list_page", f"WITH {JOBS} SELECT job_id, status, created_at, progress FROM jobs WHERE status = 'processing' ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 100")
def job_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.jobs(spark, sf_dir).where("status = 'processing'").select("job_id", "status", "created_at", "progress")
    return jobs.page_of(found, [F.desc("created_at"), F.col("job_id")], 100, 50)


@query(
    "job_eta",
    f"""WITH {JOBS} SELECT job_id, status, progress, CASE WHEN status = 'processing' AND progress > 0 THEN round(greatest(0.0, (epoch(TIMESTAMP '{NOW}') - epoch(started_at)) / progress - (epoch(TIMESTAMP '{NOW}') - epoch(started_at))), 4) END AS eta_seconds,
  CASE WHEN status = 'pending' THEN 'Job is queued for processing' WHEN status = 'completed' THEN 'Processing completed successfully' WHEN progress < 0.1 THEN 'Analyzing document structure...' WHEN progress < 0.3 THEN 'Performing OCR extraction...'
  WHEN progress < 0.7 THEN 'Detecting and extracting tables...' WHEN progress < 0.9 THEN 'Post-processing and validation...' ELSE 'Finalizing results...' END AS message FROM jobs""",
)
def job_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(jobs.progress(tables.jobs(spark, sf_dir), NOW), eta_seconds=4)


@query("jobs_without_results", f"WITH {JOBS}, {RESULTS} SELECT job_id, status FROM jobs WHERE job_id NOT IN (SELECT job_id FROM results)")
def jobs_without_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.jobs(spark, sf_dir).join(tables.page_results(spark, sf_dir), "job_id", "left_anti").select("job_id", "status")


@query("jobs_with_results", f"WITH {JOBS}, {RESULTS} SELECT job_id, status FROM jobs WHERE job_id IN (SELECT job_id FROM results)")
def jobs_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.jobs(spark, sf_dir).join(tables.page_results(spark, sf_dir), "job_id", "left_semi").select("job_id", "status")


@query("job_details", f"WITH {JOBS}, {RESULTS} SELECT job_id, status, page_number, word_count FROM jobs JOIN results USING (job_id) WHERE job_id = 7")
def job_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.jobs(spark, sf_dir).join(tables.page_results(spark, sf_dir), "job_id").where("job_id = 7").select("job_id", "status", "page_number", "word_count")


@query(
    "processor_stats",
    f"""WITH {JOBS}, t AS (SELECT status, epoch(completed_at) - epoch(started_at) AS s FROM jobs)
SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status <> 'completed') AS others, round(coalesce(avg(s), 0), 6) AS avg_seconds, coalesce(min(s), 0)::BIGINT AS min_seconds, coalesce(max(s), 0)::BIGINT AS max_seconds FROM t""",
)
def processor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return tables.jobs(spark, sf_dir).agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") != "completed").alias("others"), F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias("avg_seconds"),
        F.coalesce(F.min(s), F.lit(0)).alias("min_seconds"), F.coalesce(F.max(s), F.lit(0)).alias("max_seconds"),
    )


@query("throughput", f"WITH {RESULTS} SELECT job_id, count(*) AS pages, round(CASE WHEN sum(processing_time_ms) > 0 THEN count(*) / (sum(processing_time_ms) / 1000) ELSE 0 END, 6) AS pages_per_s, round(CASE WHEN sum(processing_time_ms) > 0 THEN sum(word_count) / (sum(processing_time_ms) / 1000) ELSE 0 END, 6) AS words_per_s FROM results GROUP BY job_id")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.sum("processing_time_ms") / 1000
    return tables.page_results(spark, sf_dir).groupBy("job_id").agg(
        F.count("*").alias("pages"), F.round(scalars.throughput(F.count("*"), s), 6).alias("pages_per_s"), F.round(scalars.throughput(F.sum("word_count"), s), 6).alias("words_per_s")
    )


@query("recent20", f"WITH {JOBS} SELECT job_id, created_at, round(document_size / 1024, 4) AS size_kb FROM jobs ORDER BY created_at DESC, job_id LIMIT 20")
def recent20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.jobs(spark, sf_dir).orderBy(F.desc("created_at"), "job_id").limit(20).select("job_id", "created_at", F.round(F.col("document_size") / 1024, 4).alias("size_kb"))


@query("processing_trend", f"WITH {JOBS} SELECT date_trunc('day', created_at)::TIMESTAMP AS day, count(*) AS n, round(avg(epoch(completed_at) - epoch(started_at)), 6) AS avg_seconds FROM jobs WHERE status = 'completed' GROUP BY 1")
def processing_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return tables.jobs(spark, sf_dir).where("status = 'completed'").groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("avg_seconds"))


@query(
    "retention_sweep",
    """SELECT count(*) FILTER (o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 1 DAY) AS files_deleted, round(coalesce(sum(o_totalprice) FILTER (o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 1 DAY), 0), 2) AS bytes_freed, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 1 DAY) AS files_kept FROM orders""",
)
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.jobs(spark, sf_dir).select(F.col("created_at").alias("modified_at"), F.col("document_size").alias("bytes"))
    return jobs.retention(files, AS_OF, 1).withColumn("bytes_freed", F.round("bytes_freed", 2))


@query("batch_uploads", "WITH u AS (SELECT o_custkey AS batch_id, CASE WHEN o_totalprice > 300000 THEN 'too large' END AS reason FROM orders) SELECT batch_id, count(*) AS total, CASE WHEN count(*) > 10 THEN 0 ELSE count(*) - count(reason) END AS accepted, count(*) - CASE WHEN count(*) > 10 THEN 0 ELSE count(*) - count(reason) END AS refused FROM u GROUP BY batch_id")
def batch_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.when(F.col("o_totalprice") > 300000, "too large").alias("reason"))
    return jobs.batch_totals(uploads)


@query("activated_checkpoints", "SELECT p_partkey AS checkpoint_id, p_brand AS model_name, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN p_partkey = 1 ELSE p_size > 25 END AS is_active FROM part")
def activated_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("checkpoint_id"), F.col("p_brand").alias("model_name"), (F.col("p_size") > 25).alias("is_active"))
    return jobs.activated(models, models.agg(F.min("model_name")).first()[0], 1)


# Files, hashes and caches.


@query(
    "mime_and_type_routing",
    rf"""WITH {FILES}, e AS (SELECT *, lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1)) AS ext FROM files)
SELECT file_id, CASE WHEN ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.tif', '.webp') THEN 'image' WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.doc', '.docx') THEN 'docx' WHEN ext IN ('.txt', '.rtf', '.odt', '.html', '.md') THEN 'text' ELSE 'unknown' END AS document_type,
  CASE WHEN ext = '.pdf' THEN 'application/pdf' WHEN ext = '.png' THEN 'image/png' WHEN ext IN ('.jpg', '.jpeg') THEN 'image/jpeg' WHEN ext = '.html' THEN 'text/html' WHEN ext = '.txt' THEN 'text/plain' WHEN starts_with(content, '%PDF') THEN 'application/pdf' WHEN starts_with(content, 'PK') THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime_type FROM e""",
)
def mime_and_type_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.source_files(spark, sf_dir)
    return f.select("file_id", scalars.document_type(F.col("path")).alias("document_type"), scalars.mime_type(F.col("path"), F.col("content").cast("binary")).alias("mime_type"))


@query("upload_validation", rf"""WITH {FILES} SELECT file_id, CASE WHEN length(content) > 9000 THEN 'too large' WHEN length(path) > 255 THEN 'name too long' WHEN contains(path, '..') OR regexp_matches(path, '[/\\<>:"|?*]') THEN 'name not allowed' END AS reason FROM files""")
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.source_files(spark, sf_dir)
    size = F.when(F.length("content") > 9000, scalars.MAX_BYTES + 1).otherwise(0)
    return f.select("file_id", scalars.rejection(F.col("path"), size, F.lit("application/pdf")).alias("reason"))


@query("endpoint_labels", rf"""WITH {FILES}, p AS (SELECT file_id, '/api/v1/' || ['jobs', 'status', 'result', 'review', 'webhooks', 'upload', 'webhooks'][file_id % 7 + 1] || '/' || CASE WHEN file_id % 7 = 4 THEN 'register' ELSE file_id::VARCHAR END AS path FROM files)
SELECT file_id, CASE file_id % 7 WHEN 0 THEN '/jobs/{{job_id}}' WHEN 1 THEN '/status/{{job_id}}' WHEN 2 THEN '/result/{{job_id}}' WHEN 3 THEN '/review/{{job_id}}' WHEN 4 THEN '/webhooks/{{webhook_id}}' WHEN 6 THEN '/webhooks/{{webhook_id}}' ELSE path END AS label FROM p""")
def endpoint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("jobs", "status", "result", "review", "webhooks", "upload", "webhooks")))
    kind = F.element_at(kinds, (F.col("file_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("/api/v1/"), kind, F.lit("/"), F.when(F.col("file_id") % 7 == 4, "register").otherwise(F.col("file_id").cast("string")))
    return tables.source_files(spark, sf_dir).select("file_id", scalars.endpoint_label(path).alias("label"))


@query("content_hash_dupes", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = tables.table(spark, sf_dir, "documents").select("doc_id", scalars.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1")


@query("shard_paths", "SELECT doc_id, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS path FROM documents")
def shard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", scalars.shard_path(scalars.content_hash(F.col("text"))).alias("path"))


_CACHE = "stored AS (SELECT DISTINCT sha256(text) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 END AS mode FROM documents WHERE doc_id % 2 = 0), asked AS (SELECT doc_id, sha256(text) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 END AS mode FROM documents)"


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mode = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3).alias("mode")
    asked = tables.table(spark, sf_dir, "documents").select("doc_id", scalars.content_hash(F.col("text")).alias("content_hash"), mode)
    stored = tables.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(scalars.content_hash(F.col("text")).alias("content_hash"), mode)
    return asked, stored


@query("cache_hits", f"WITH {_CACHE} SELECT doc_id FROM asked a WHERE EXISTS (SELECT 1 FROM stored s WHERE s.content_hash = a.content_hash AND s.mode IS NOT DISTINCT FROM a.mode)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cache_hits(*_cache(spark, sf_dir), ["content_hash", "mode"]).select("doc_id")


@query("cache_misses", f"WITH {_CACHE} SELECT doc_id FROM asked a WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.content_hash = a.content_hash AND s.mode IS NOT DISTINCT FROM a.mode)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cache_misses(*_cache(spark, sf_dir), ["content_hash", "mode"]).select("doc_id")


# Requests.


@query("latest_status_per_user", 'SELECT client, endpoint, "at" FROM (SELECT user_id AS client, event_type AS endpoint, ts AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1')
def latest_status_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(tables.requests(spark, sf_dir), "client", "endpoint", "at", "request_id")


@query("request_counter", f"WITH {REQUESTS} SELECT endpoint, count(*) AS n FROM requests GROUP BY 1")
def request_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.request_counts(tables.requests(spark, sf_dir))


@query("duration_buckets", f"WITH {REQUESTS} SELECT endpoint, (SELECT count(*) FROM requests t WHERE t.endpoint = r.endpoint) AS total, le, count(*) FILTER (duration_s <= le) AS n FROM requests r, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0])::DOUBLE AS le) GROUP BY endpoint, le")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.duration_buckets(tables.requests(spark, sf_dir))


@query("api_metrics", f"WITH {REQUESTS} SELECT count(*) AS requests, round(count(*) FILTER (endpoint <> 'error') / greatest(count(*), 1), 6) AS success_rate, round(coalesce(sum(duration_s), 0) / greatest(count(*), 1), 6) AS avg_time_s FROM requests")
def api_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(jobs.api_metrics(tables.requests(spark, sf_dir), F.col("endpoint") == "error"), success_rate=6, avg_time_s=6)


@query("offered_load_1d", f"WITH {REQUESTS} SELECT request_id, client, count(*) OVER (PARTITION BY client ORDER BY floor(epoch(\"at\")) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS load FROM requests")
def offered_load_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.offered_load(tables.requests(spark, sf_dir), 86_400)


_YOUNG = "list_filter(a.kept, lambda t: e.s - t < 86400)"


@query(
    "admitted_requests",
    f"""WITH {REQUESTS}, timed AS (SELECT request_id, client, floor(epoch("at"))::BIGINT AS s FROM requests),
c AS (SELECT client, list(struct_pack(s := s, kept := []::BIGINT[], out := []::BOOLEAN[]) ORDER BY s, request_id) AS es, list(request_id ORDER BY s, request_id) AS ids FROM timed GROUP BY client),
f AS (SELECT client, ids, list_reduce(list_prepend(struct_pack(s := 0::BIGINT, kept := []::BIGINT[], out := []::BOOLEAN[]), es), lambda a, e: struct_pack(s := e.s, kept := CASE WHEN len({_YOUNG}) < 5 THEN list_append({_YOUNG}, e.s) ELSE {_YOUNG} END, out := list_append(a.out, len({_YOUNG}) < 5))).out AS out FROM c)
SELECT unnest(ids) AS request_id, client, unnest(out) AS admitted FROM f""",
)
def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.admitted(tables.requests(spark, sf_dir), 5, 86_400)


@query("json_props", f"WITH {REQUESTS} SELECT request_id, (metadata->>'$.k')::BIGINT AS k FROM requests")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.requests(spark, sf_dir).select("request_id", F.get_json_object("metadata", "$.k").cast("long").alias("k"))


@query("metric_summary", f"WITH {REQUESTS} SELECT endpoint, count(*) AS n, round(avg(metric_value) + 1e-9, 6) AS mean, round(median(metric_value) + 1e-9, 6) AS median, round(stddev_pop(metric_value) + 1e-9, 6) AS std, min(metric_value) AS least, max(metric_value) AS most FROM requests GROUP BY endpoint")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(confidence.stats_of_large_groups(tables.requests(spark, sf_dir), "endpoint", value="metric_value"), "mean", "median", "std")


@query("session_activity", "SELECT client, sum(new)::BIGINT AS sessions, max(\"at\") AS last_activity FROM (SELECT user_id AS client, ts AS \"at\", CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) GROUP BY client")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("client").orderBy("at")
    gap = F.col("at") - F.lag("at").over(w)
    each = tables.requests(spark, sf_dir).select("client", "at", F.when(gap <= F.expr("INTERVAL '6' HOUR"), 0).otherwise(1).alias("new"))
    return each.groupBy("client").agg(F.sum("new").alias("sessions"), F.max("at").alias("last_activity"))


# Exports.


@query(
    "csv_union_export",
    f"""WITH {TOKENS}, {_REGIONS}, cells AS (SELECT doc_id, page_num, page_num::BIGINT AS table_num, pos // 5 + 1 AS row_num, pos % 5 + 1 AS column_num, text AS cell_text FROM tokens)
SELECT doc_id, page_num AS page, region_text AS text, confidence, 'text' AS type, x1 AS x, y1 AS y, NULL::BIGINT AS "table", NULL::BIGINT AS "row", NULL::BIGINT AS "column" FROM regions
UNION ALL SELECT doc_id, page_num, cell_text, 1.0, 'table_cell', NULL, NULL, table_num, row_num, column_num FROM cells""",
)
def csv_union_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.flat_rows(_line_regions(spark, sf_dir), _fixture_cells(spark, sf_dir))


def _fixture_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's words as a table of five columns."""
    t = tables.tokens(spark, sf_dir)
    return t.select("doc_id", "page_num", F.col("page_num").cast("long").alias("table_num"), (F.floor(F.col("pos") / 5) + 1).alias("row_num"), (F.col("pos") % 5 + 1).alias("column_num"), F.col("text").alias("cell_text"))


@query(
    "padded_tables",
    f"""WITH {TOKENS}, cells AS (SELECT doc_id, page_num::BIGINT AS table_num, pos // 5 + 1 AS row_num, pos % 5 + 1 AS column_num, text FROM tokens), widths AS (SELECT doc_id, table_num, column_num, max(length(text)) + 2 AS width FROM cells GROUP BY ALL)
SELECT doc_id, table_num, row_num, string_agg(rpad(text, width::INT, ' '), '' ORDER BY column_num) AS line FROM cells JOIN widths USING (doc_id, table_num, column_num) GROUP BY ALL""",
)
def padded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda t: F.struct((F.floor(t.pos / 5) + 1).alias("row_num"), (t.pos % 5 + 1).alias("column_num"), t.text.alias("cell_text"))
    return exports.padded(tables.token_pages(spark, sf_dir).select("doc_id", F.col("page_num").cast("long").alias("table_num"), F.transform("ts", cell).alias("cells")))


@query("line_position_export", f"""WITH {TOKENS} SELECT doc_id, page_num AS page_number, pos // 15 + 1 AS line_number, pos % 15 + 1 AS position, text, confidence, x1, y1 FROM tokens""")
def line_position_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.tokens(spark, sf_dir)
    return exports.line_rows(t.withColumn("line_num", F.floor(F.col("pos") / 15) + 1).withColumn("position", F.col("pos") % 15 + 1))


@query(
    "document_totals",
    f"""WITH {TOKENS} SELECT doc_id, count(DISTINCT page_num) AS page_count, count(*) AS word_count, count(DISTINCT page_num) AS table_count FROM tokens GROUP BY doc_id""",
)
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.document_totals(tables.tokens(spark, sf_dir), _fixture_cells(spark, sf_dir))


@query("wide_boxes", f"""WITH {TOKENS} SELECT doc_id, page_num, pos FROM tokens WHERE x2 - x1 > 20 AND y2 - y1 > 10""")
def wide_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.wide_boxes(tables.tokens(spark, sf_dir)).select("doc_id", "page_num", "pos")


@query("large_boxes", f"""WITH {TOKENS} SELECT doc_id, page_num, pos FROM tokens WHERE (x2 - x1) * (y2 - y1) > 600 * 100 * 0.01""")
def large_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.large_boxes(tables.tokens(spark, sf_dir), F.lit(600), F.lit(100)).select("doc_id", "page_num", "pos")


@query("line_positions", f"""WITH {TOKENS} SELECT doc_id, page_num, string_agg(DISTINCT x1, ',' ORDER BY x1) AS positions FROM tokens GROUP BY ALL""")
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_positions(tables.tokens(spark, sf_dir)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(
    "recognizer_results",
    f"""WITH {TOKENS} SELECT doc_id, page_num, pos, text, x1, y1, x2, y2, confidence FROM tokens""",
)
def recognizer_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as results of both formats, by the document's number, read back to tokens."""
    corners = lambda t: F.array(F.array(t.x1, t.y1), F.array(t.x2, t.y1), F.array(t.x2, t.y2), F.array(t.x1, t.y2)).cast("array<array<double>>")
    word = lambda t: F.struct(t.pos.alias("pos"), t.text.alias("text"), t.confidence.alias("confidence"), corners(t).alias("poly"))
    pages = tables.token_pages(spark, sf_dir).select("doc_id", "page_num", F.transform("ts", word).alias("ts"))
    named = F.to_json(F.array(F.struct(F.transform("ts", lambda w: w.text).alias("rec_texts"), F.transform("ts", lambda w: w.confidence).alias("rec_scores"), F.transform("ts", lambda w: w.poly).alias("rec_polys"))))
    # A page is written at once, as objects; quotes within texts are escaped, so that what looks like a key is one, and keys become the brackets of lists.
    objects = F.to_json(F.transform("ts", lambda w: F.struct(w.poly.alias("p"), F.struct(w.text.alias("t"), w.confidence.alias("c")).alias("w"))))
    listed = F.regexp_replace(F.replace(F.replace(objects, F.lit('{"p":'), F.lit("[")), F.lit(',"w":{"t":'), F.lit(",[")), r',"c":([^}]*)\}\}', ",$1]]")
    listed = F.concat(F.lit("["), listed, F.lit("]"))
    out = readers.result_tokens(pages.select("doc_id", "page_num", F.when(F.col("doc_id") % 2 == 0, named).otherwise(listed).alias("result")))
    return out.select("doc_id", "page_num", "pos", "text", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "confidence")


@query("dynamic_columns_pivot", """SELECT doc_id, CASE WHEN lang = 'de' THEN source ELSE '' END AS de, CASE WHEN lang = 'en' THEN source ELSE '' END AS en, CASE WHEN lang = 'es' THEN source ELSE '' END AS es, CASE WHEN lang = 'fr' THEN source ELSE '' END AS fr, source AS "source" FROM documents""")
def dynamic_columns_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.col("lang"), F.col("source"), F.lit("source"), F.col("source")).alias("columns"))
    return exports.dynamic_columns(rows)[0]


@query("text_report", f"""WITH {TOKENS}, p AS (SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY pos) AS t FROM tokens GROUP BY ALL) SELECT doc_id, string_agg('=== Page ' || page_num || ' ===' || chr(10) || t || chr(10), chr(10) ORDER BY page_num) AS report FROM p GROUP BY doc_id""")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.text_report(layout.page_text(tables.token_pages(spark, sf_dir)))


@query("marked_text", f"""WITH {LINES} SELECT doc_id, ln + 1 AS page_num, CASE ln % 4 WHEN 0 THEN '## ' || line WHEN 1 THEN '### ' || line WHEN 2 THEN '* ' || trim(line) ELSE line END AS marked FROM lines""")
def marked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    kind = F.element_at(F.array(*map(F.lit, ("heading", "subheading", "list", "paragraph"))), F.col("ln") % 4 + 1)
    return lines.select("doc_id", (F.col("ln") + 1).alias("page_num"), scalars.marked(F.col("line"), kind).alias("marked"))


@query(
    "page_json",
    f"""WITH {TOKENS}, pages AS (SELECT doc_id, page_num, list({{'text': text, 'bbox': [x1, y1, x2, y2], 'confidence': confidence}} ORDER BY pos) AS tokens FROM tokens GROUP BY ALL)
SELECT doc_id, to_json({{'id': doc_id, 'pages': list({{'page_num': page_num, 'tokens': tokens}} ORDER BY page_num)}})::VARCHAR AS json FROM pages GROUP BY doc_id""",
)
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.page_json(tables.paged(tables.texts(spark, sf_dir)))


@query(
    "page_xml",
    f"""WITH {TOKENS}, body AS (SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY pos) AS t, round(avg(confidence) + 1e-9, 6) AS c FROM tokens GROUP BY ALL)
SELECT doc_id, page_num, '<Page>' || chr(10) || '    <Number>' || page_num || '</Number>' || chr(10) || '    <Text>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</Text>' || chr(10) || '    <Confidence>' || c || '</Confidence>' || chr(10) || '</Page>' AS xml FROM body""",
)
def page_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.page_xml(tables.token_pages(spark, sf_dir))


@query(
    "markdown_report",
    f"""SELECT doc_id, '# OCR Processing Report' || chr(10) || chr(10) || '- **Pages Processed:** ' || page_count || chr(10) || '- **Words Extracted:** ' || format('{{:,}}', word_count) || chr(10) || '- **Average Confidence:** ' || round((avg_confidence * 100)::VARCHAR::DECIMAL(20, 15), 1)::DECIMAL(10, 1) || '%'
  || chr(10) || '- **High Confidence Tokens (>90%):** ' || high_count || chr(10) || '- **Medium Confidence Tokens (70-90%):** ' || medium_count || chr(10) || '- **Low Confidence Tokens (<70%):** ' || low_count AS report FROM ({SQL["doc_summary"]})""",
)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.markdown_report(doc_summary(spark, sf_dir))


# Extensions: text clean-up, with semantics of our own.


@query("masked_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b', '[card]', 'g'), '\+[0-9][0-9 -]{7,14}[0-9]', '[phone]', 'g') AS masked FROM documents""")
def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", scalars.masked(F.col("text")).alias("masked"))


# Boxes to draw, kinds of files, checks of uploads, and words by line.


@query("annotations", f"WITH {TOKENS} SELECT doc_id, page_num, pos, x1, y1, x2, y2, round(1 - confidence, 6) AS red, confidence AS green, 0.0::DOUBLE AS blue FROM tokens")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exports.annotations(tables.tokens(spark, sf_dir))
    return out.select("doc_id", "page_num", "pos", "x1", "y1", "x2", "y2", F.round("colour.r", 6).alias("red"), F.col("colour.g").alias("green"), F.col("colour.b").alias("blue"))


_TYPED = rf"""{FILES}, typed AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, octet_length(encode(content))::BIGINT AS size, lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1)) AS ext FROM files),
kinds AS (SELECT *, CASE WHEN ext = '.pdf' THEN 'application/pdf' WHEN ext = '.png' THEN 'image/png' WHEN ext IN ('.jpg', '.jpeg') THEN 'image/jpeg' WHEN ext = '.html' THEN 'text/html' WHEN ext = '.txt' THEN 'text/plain' WHEN ext = '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime FROM typed)"""


@query(
    "upload_checks",
    rf"""WITH {_TYPED} SELECT file_id, size, mime, CASE WHEN size > 52428800 THEN 'too large' WHEN mime NOT IN ('application/pdf', 'image/jpeg', 'image/png', 'image/tiff', 'text/html', 'application/octet-stream') THEN 'type not allowed' WHEN trim(name) = '' THEN 'no name' WHEN length(name) > 255 THEN 'name too long'
  WHEN contains(name, '..') OR regexp_matches(name, '[/\\<>:"|?*]') THEN 'name not allowed' END AS reason FROM kinds""",
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as uploads: the name is the last part of the path, the size that of the content, the type what both tell."""
    f = tables.source_files(spark, sf_dir)
    rows = f.select("file_id", F.element_at(F.split("path", "/"), -1).alias("name"), F.octet_length("content").cast("long").alias("size"), scalars.mime_type(F.col("path")).alias("mime"))
    allowed = ("application/pdf", "image/jpeg", "image/png", "image/tiff", "text/html", "application/octet-stream")
    return rows.select("file_id", "size", "mime", scalars.rejection(F.col("name"), F.col("size"), F.col("mime"), allowed).alias("reason"))


@query(
    "render_types",
    rf"""WITH {_TYPED} SELECT file_id, CASE WHEN mime = 'application/pdf' AND length(content) > 2000 THEN 'digital_pdf' WHEN mime = 'application/pdf' THEN 'scanned_image' WHEN starts_with(mime, 'image/') THEN 'photograph' WHEN contains(mime, 'word') THEN 'docx' ELSE 'scanned_image' END AS render_type, 0.5::DOUBLE AS confidence FROM kinds""",
)
def render_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = scalars.render_type(scalars.mime_type(F.col("path")), F.length("content") > 2000)
    return tables.source_files(spark, sf_dir).select("file_id", kind.alias("k")).select("file_id", F.col("k.render_type").alias("render_type"), F.col("k.confidence").cast("double").alias("confidence"))


@query("line_word_rows", f"WITH {TOKENS}, " + _FOLD.format(most="12", source="tokens", more="").partition("SELECT doc_id, page_num, line_num::BIGINT")[0] + "SELECT doc_id, page_num, line_num::BIGINT AS line_num, row_number() OVER (PARTITION BY doc_id, page_num, line_num ORDER BY i) AS position, text, y1 FROM each")
def line_word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the lines that the line operator finds, and their places in them."""
    found = layout.line_slices(tables.token_pages(spark, sf_dir))
    return found.select("doc_id", "page_num", "line_num", F.posexplode("ts").alias("i", "t")).select("doc_id", "page_num", "line_num", (F.col("i") + 1).cast("long").alias("position"), "t.text", "t.y1")


@query("pipeline_stats", f"WITH {JOBS} SELECT processing_mode, status, count(*) AS jobs, round(avg(progress), 6) AS avg_progress FROM jobs GROUP BY ALL")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.jobs(spark, sf_dir).groupBy("processing_mode", "status").agg(F.count("*").alias("jobs"), F.round(F.avg("progress"), 6).alias("avg_progress"))
