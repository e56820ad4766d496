"""URL filters: rules by host and path, and for all other URLs a tree of path templates with smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word stays a branch of its own with so many pages and at least this share of its parent's: at most 1 / SHARE branches.
SUPPORT, SHARE = 8, 1 / 64
#: Weight of the parent's purity in labelled pages; sibling rates within so many standard errors merge; purity that rejects.
SMOOTHING, STANDARD_ERRORS, REJECT = 4.0, 1.96, 0.8

#: Shapes of variable segments, in order: the first that fits names the wildcard.
SHAPES = (
    (r"^[0-9]+$", "{number}"),
    (r"^[0-9]+\.[A-Za-z]{1,5}$", "{number.ext}"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
    (r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", "{uuid}"),
    (r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{hex}"),
    (r"[0-9]", "{mixed}"),
    (r"^.{40,}$|(-.+){3}", "{slug}"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and for URLs without ://."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<action, rule> of the longest rule (host and path) that fits the host or a subdomain of it; else null."""
    known = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        known.append(F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"), F.lit(name).alias("host"), F.lit(slash + start).alias("path")))
    if not known:
        return F.lit(None).cast("struct<action: string, rule: string, host: string, path: string>")
    fits = F.filter(F.array(*known), lambda r: ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path))
    return F.get(fits, F.lit(0))


def shape(segment: Column) -> Column:
    out = F
    for pattern, name in SHAPES:
        out = out.when(segment.rlike(pattern), name)
    return out


def templates(paths: DataFrame, scope: str = "") -> DataFrame:
    """Adds `template`, an array of segments, to distinct paths (host, path, n, ...), n of which stand in the table.

    Level by level below each host: variable shapes become wildcards, as do words that are rare below their parent. Levels
    follow as long as a parent has SUPPORT pages below it; of fewer, no word could be a branch, and what is left of their
    paths is one wildcard. Only paths that go on below such a parent are carried to the next level, all others are set
    aside: a few deep paths cost as many small tables, never the whole table again. Only counts by (host, prefix, word)
    are shuffled, after partial aggregation, so that a host may hold any share of rows.
    """
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    keep = [*paths.columns, "template"]
    out = paths.withColumn("_parts", parts).withColumn("template", F.array().cast("array<string>"))
    level, done = 0, None
    while True:
        part = F.get("_parts", F.lit(level))
        here = out.withColumn("_part", part).withColumn("_shape", shape(F.col("_part")))
        counts = here.where(F.col("_part").isNotNull()).groupBy("host", "template", F.when(F.col("_shape").isNull(), F.col("_part")).alias("_word")).agg(F.sum("n").alias("_n"))
        parents = counts.groupBy("host", "template").agg(F.sum("_n").alias("_all")).where(F.col("_all") >= SUPPORT)
        often = counts.where(F.col("_word").isNotNull() & (F.col("_n") >= SUPPORT)).join(parents, ["host", "template"]).where(F.col("_n") >= F.col("_all") * SHARE)
        words = parents.join(often.groupBy("host", "template").agg(F.collect_set("_word").alias("_words")), ["host", "template"], "left")
        joined = here.join(words, ["host", "template"], "left")
        named = F.coalesce(F.col("_shape"), F.when(F.array_contains("_words", F.col("_part")), F.col("_part")), F.lit("{word}"))
        below = F.when(F.col("_part").isNull(), F.col("template")).when(F.col("_all").isNull(), F.concat("template", F.array(F.lit("{rest}")))).otherwise(F.concat("template", F.array(named)))
        goes_on = F.col("_part").isNotNull() & F.col("_all").isNotNull() & (F.size("_parts") > level + 1)
        step = saved(joined.select(*paths.columns, below.alias("template"), "_parts", goes_on.alias("_open")), "url-level", scope)
        closed = step.where("not _open").select(*keep)
        done = closed if done is None else done.unionByName(closed)
        out, level = step.where("_open").drop("_open"), level + 1
        if out.isEmpty():
            return done


def merged_branches(stats: DataFrame, scope: str = "") -> DataFrame:
    """stats (host, template, n, good, bad) with `merged`: sibling words whose labelled rates don't differ are one branch.

    Siblings have the same template but for the word of one level (at most 1 / SHARE words). In the order of their
    rates, each is held against the one before it by the two-proportion test; unlabelled siblings are a branch apart.
    """
    out = stats.withColumn("merged", F.col("template"))
    depth = stats.agg(F.max(F.size("template"))).first()[0] or 0
    for level in range(depth - 1, -1, -1):
        word = F.get("merged", F.lit(level))
        same = out.where(word.isNotNull() & ~F.startswith(word, F.lit("{"))).groupBy("host", "merged").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        key = F.concat(F.slice("merged", 1, level), F.array(F.lit("*")), F.slice("merged", level + 2, depth))
        n = F.col("good") + F.col("bad")
        each = same.select("host", "merged", key.alias("key"), word.alias("word"), n.alias("n"), F.when(n > 0, F.col("bad") / n).alias("rate"))
        w = Window.partitionBy("host", "key", F.col("rate").isNull()).orderBy("rate", "word")
        n0, r0 = F.lag("n").over(w), F.lag("rate").over(w)
        pooled = (F.col("rate") * F.col("n") + r0 * n0 + 0.5) / (F.col("n") + n0 + 1)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / n0))
        splits = F.coalesce(F.col("rate").isNotNull() & (F.col("rate") - r0 > STANDARD_ERRORS * error), F.lit(False))
        runs = each.withColumn("new", splits.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        family = Window.partitionBy("host", "key", F.col("rate").isNull(), "run")
        named = runs.withColumn("size", F.count("*").over(family)).withColumn("least", F.min("word").over(family)).where("size > 1")
        branch = named.select("host", "merged", F.concat(F.slice("merged", 1, level), F.array(F.concat(F.lit("{like "), "least", F.lit("}"))), F.slice("merged", level + 2, depth)).alias("_branch"))
        out = saved(out.join(branch, ["host", "merged"], "left").select(*stats.columns, F.coalesce("_branch", "merged").alias("merged")), "url-merged", scope)
    return out


def rejected_templates(stats: DataFrame, scope: str = "") -> DataFrame:
    """The (host, template) pairs whose branch is labelled bad with a smoothed purity of REJECT or more.

    A branch's purity is its bad share, smoothed by that of its first segment's branch, that by the host's, and that by
    the share of bad pages over all.
    """
    merged = saved(merged_branches(stats, scope), "url-branches", scope)
    bad, n = F.sum("bad").alias("bad"), F.sum(F.col("good") + F.col("bad")).alias("n")
    top = F.coalesce(F.get("merged", F.lit(0)), F.lit(""))
    every = merged.agg(bad, n).first()
    prior = (every["bad"] or 0) / every["n"] if every["n"] else 0.0
    smooth = lambda above: (F.col("bad") + SMOOTHING * above) / (F.col("n") + SMOOTHING)
    hosts = merged.groupBy("host").agg(bad, n).select("host", smooth(F.lit(prior)).alias("host_purity"))
    tops = merged.groupBy("host", top.alias("top")).agg(bad, n).join(hosts, "host").select("host", "top", smooth(F.col("host_purity")).alias("top_purity"))
    branches = merged.groupBy("host", "merged").agg(bad, n).withColumn("top", top).join(tops, ["host", "top"])
    rejected = branches.where(smooth(F.col("top_purity")) >= REJECT).select("host", "merged")
    return merged.join(rejected, ["host", "merged"]).select("host", "template")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], *, page_id: str = "page_id", url: str = "url", scope: str = "") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A URL that a rule fits gets its action, and is a labelled page of the tree; all others are blocked if their template is
    rejected, else allowed. Repeated rows count as often as they stand there; null URLs and URLs without a
    host are allowed unless a rule fits. Other columns of pages have no part in it.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.action").alias("action"))
    rows = saved(rows, "url-rows", scope)
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "allow").alias("good"), F.count_if(F.col("action") == "block").alias("bad"))
    paths = saved(templates(saved(paths, "url-paths", scope), scope), "url-templates", scope)
    stats = paths.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    rejected = saved(rejected_templates(saved(stats, "url-stats", scope), scope).withColumn("_rejected", F.lit(True)), "url-rejected", scope)
    known = saved(paths.join(lookup(rejected), ["host", "template"], "left").select("host", "path", "template", "_rejected"), "url-known", scope)
    method = F.when(F.col("_rejected"), "block").otherwise("allow")
    out = rows.join(lookup(known), ["host", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"))


#: Fixed by the contract of op4.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
