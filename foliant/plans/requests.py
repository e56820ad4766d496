"""Queries over requests, jobs and what they may do, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import scalars
from foliant.operators import jobs
from foliant.plans import pipeline
from foliant.plans.catalogue import JOBS, REQUESTS, RESULTS, TOKENS, query, told
from foliant.sources import tables

BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
_ASKED = f"""{REQUESTS}, asked AS (SELECT *, ['GET', 'POST', 'DELETE'][request_id % 3 + 1] AS method, CASE WHEN endpoint = 'error' THEN 500 WHEN request_id % 10 = 0 THEN 429 WHEN request_id % 17 = 0 THEN 404 ELSE 200 END AS status_code FROM requests)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a method and the status of their answer."""
    at = F.col("request_id")
    status = F.when(F.col("endpoint") == "error", 500).when(at % 10 == 0, 429).when(at % 17 == 0, 404).otherwise(200)
    return tables.requests(spark, sf_dir).withColumns({"method": F.element_at(F.array(*map(F.lit, ("GET", "POST", "DELETE"))), (at % 3 + 1).cast("int")), "status_code": status})


@query(
    "request_metrics",
    f"""WITH {_ASKED}, h AS (SELECT method, endpoint, count(*) AS total, round(sum(duration_s), 6) AS seconds, {', '.join(f"count(*) FILTER (duration_s <= {b}) AS le_{i}" for i, b in enumerate(BOUNDS))} FROM asked GROUP BY ALL)
SELECT c.method, c.endpoint, status_code, requests, total, seconds, {', '.join(f'le_{i}' for i in range(len(BOUNDS)))} FROM (SELECT method, endpoint, status_code, count(*) AS requests FROM asked GROUP BY ALL) c JOIN h ON c.method = h.method AND c.endpoint = h.endpoint""",
)
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = told(jobs.request_metrics(_asked(spark, sf_dir), BOUNDS), seconds=6)
    return out.select("method", "endpoint", "status_code", "requests", "total", "seconds", *(F.col("upto")[str(b)].alias(f"le_{i}") for i, b in enumerate(BOUNDS)))


@query(
    "job_rates",
    f"""WITH {JOBS}, {RESULTS}, s AS (SELECT job_id, count(*) AS pages, sum(word_count) AS words, sum(processing_time_ms) / 1000 AS seconds FROM results GROUP BY job_id)
SELECT job_id, round(seconds, 5) AS seconds, round(pages / seconds, 6) AS pages_per_s, round(words / seconds, 6) AS words_per_s, round(document_size / 1024 / seconds, 6) AS kb_per_s FROM s JOIN jobs USING (job_id)""",
)
def job_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(jobs.job_rates(tables.jobs(spark, sf_dir), tables.page_results(spark, sf_dir)), seconds=5, pages_per_s=6, words_per_s=6, kb_per_s=6)


@query(
    "mode_flags",
    f"""WITH {JOBS}, p AS (SELECT job_id, ['basic', ' Advanced', 'standard', 'other', NULL][job_id % 5 + 1] AS name, CASE WHEN job_id % 2 = 0 THEN job_id % 3 = 0 END AS fast, CASE WHEN job_id % 4 = 0 THEN (job_id % 9)::INT END AS pages, CASE WHEN job_id % 3 = 0 THEN job_id % 6 = 0 END AS tables, job_id % 7 < 3 AS extra FROM jobs),
m AS (SELECT *, CASE WHEN upper(trim(name)) IN ('BASIC', 'STANDARD', 'ADVANCED') THEN upper(trim(name)) ELSE 'STANDARD' END AS mode FROM p)
SELECT job_id, mode, mode = 'BASIC' OR coalesce(fast, false) AS fast, CASE WHEN mode = 'BASIC' THEN coalesce(pages, 3) ELSE pages END AS max_pages, CASE mode WHEN 'BASIC' THEN false WHEN 'STANDARD' THEN coalesce(tables, false) ELSE coalesce(tables, true) END AS extract_tables,
  mode = 'STANDARD' AND extra AS classify_document, mode = 'STANDARD' AND extra AS extract_forms, mode = 'STANDARD' AND NOT extra AS analyze_layout FROM m""",
)
def mode_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, extra = F.col("job_id"), F.col("job_id") % 7 < 3
    name = F.element_at(F.array(F.lit("basic"), F.lit(" Advanced"), F.lit("standard"), F.lit("other"), F.lit(None).cast("string")), (at % 5 + 1).cast("int"))
    flags = scalars.mode_flags(name, F.when(at % 2 == 0, at % 3 == 0), F.when(at % 4 == 0, (at % 9).cast("int")), F.when(at % 3 == 0, at % 6 == 0), extra, extra, ~extra)
    return tables.jobs(spark, sf_dir).select("job_id", flags.alias("f")).select("job_id", "f.*")


@query(
    "error_responses",
    f"""WITH {REQUESTS}, e AS (SELECT request_id, [{', '.join(f"'{k}'" for k in scalars.ERRORS)}, 'KeyError', NULL][request_id % {len(scalars.ERRORS) + 2} + 1] AS kind, CASE WHEN request_id % 4 > 0 THEN 'about "' || endpoint || '"' END AS message FROM requests),
k AS (SELECT *, CASE WHEN kind IS NULL OR kind = 'KeyError' THEN 'InternalServerError' ELSE kind END AS type FROM e),
a AS (SELECT request_id, type, message, CASE type {' '.join(f"WHEN '{k}' THEN {code}" for k, (code, _) in scalars.ERRORS.items())} END AS status_code, CASE type {' '.join(f"WHEN '{k}' THEN " + (f"'{t}'" if t else 'NULL') for k, (_, t) in scalars.ERRORS.items())} END AS told FROM k)
SELECT request_id, status_code, type, CASE WHEN type LIKE '%Exception' THEN coalesce(message, told) ELSE told END AS message, CASE WHEN type NOT LIKE '%Exception' THEN message END AS detail, request_id::VARCHAR AS asked FROM a""",
)
def error_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors answered, and the answers read again."""
    at, n = F.col("request_id"), len(scalars.ERRORS) + 2
    kind = F.element_at(F.array(*map(F.lit, scalars.ERRORS), F.lit("KeyError"), F.lit(None).cast("string")), (at % n + 1).cast("int"))
    message = F.when(at % 4 > 0, F.concat(F.lit('about "'), F.col("endpoint"), F.lit('"')))
    out = tables.requests(spark, sf_dir).select("request_id", scalars.error_response(kind, message, at.cast("string")).alias("r")).select("request_id", "r.*")
    field = lambda path: F.get_json_object("body", path)
    return out.select("request_id", "status_code", field("$.error.type").alias("type"), field("$.error.message").alias("message"), field("$.error.details.error").alias("detail"), field("$.request_id").alias("asked"))


@query(
    "role_checks",
    f"""WITH {REQUESTS}, users AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN ['viewer', 'admin'] ELSE ['viewer'] END AS roles FROM customer WHERE c_custkey % 7 > 0)
SELECT request_id, client, CASE WHEN user_id IS NULL THEN 401 WHEN coalesce(list_contains(roles, 'admin'), false) THEN 200 ELSE 403 END AS status_code FROM requests LEFT JOIN users ON client = user_id""",
)
def role_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    roles = F.when(key % 5 == 0, F.lit(None).cast("array<string>")).when(key % 2 == 0, F.array(F.lit("viewer"), F.lit("admin"))).otherwise(F.array(F.lit("viewer")))
    users = tables.table(spark, sf_dir, "customer").where(key % 7 > 0).select(key.alias("user_id"), roles.alias("roles"))
    return jobs.access(tables.requests(spark, sf_dir), users, "admin")


@query("checkpoint_list", "SELECT p_partkey AS checkpoint_id, p_brand AS model_name, p_size > 25 AS is_active, p_size AS created_at FROM part WHERE p_brand = (SELECT max(p_brand) FROM part) AND p_size > 25")
def checkpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("checkpoint_id"), F.col("p_brand").alias("model_name"), (F.col("p_size") > 25).alias("is_active"), F.col("p_size").alias("created_at"))
    return jobs.checkpoints(models, models.agg(F.max("model_name")).first()[0], is_active=True)


# What profiles are made of.


@query("profile_performance", f"WITH {TOKENS} SELECT doc_id, page_num, pos, text, confidence, confidence < 0.8 AS needs_review FROM tokens WHERE page_num <= 5 AND trim(text) <> ''")
def profile_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five pages of each document, by a profile that was stored and read again."""
    profiles = pipeline.from_config(pipeline.to_config())
    return pipeline.run(tables.tokens(spark, sf_dir), "performance", profiles=profiles).select("doc_id", "page_num", "pos", "text", "confidence", "needs_review")


@query("strict_confidence", f"WITH {TOKENS} SELECT doc_id, page_num, pos, text, confidence FROM tokens WHERE confidence > 0.9")
def strict_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = {"default": (), "strict": (pipeline.Step("tokens.confidence", {"least": 0.5, "strict": True}),)}
    out = pipeline.run(tables.tokens(spark, sf_dir), "strict", profiles=chain, overrides={"tokens.confidence": {"least": 0.9}})
    return out.select("doc_id", "page_num", "pos", "text", "confidence")
