"""Hard negatives: inverted lists of k-means clusters with their radii, visited by the Cauchy-Schwarz bound of scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

#: Numbers of the sample that clusters are fitted on and of all centroids, at most; every row is indexed. Rounds of fitting.
TRAIN_NUMBERS, CENTROID_NUMBERS, ITERATIONS = 1 << 20, 1 << 20, 5
#: Numbers in a block of a list and in a chunk of anchors; blocks of a list below one key of a join.
BLOCK_NUMBERS, CHUNK_NUMBERS, BLOCKS_A_KEY = 1 << 15, 1 << 13, 32
#: Clusters that an anchor visits in the first round; in each later one so many times as many.
FIRST, GROWTH = 8, 8
SCALE = 256
GOALS = "array<struct<goal: int, least: double, most: double>>"


def usable(df: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """vec_id, label, q (floor(256 * x) as double): rows without nulls and non-finite components; of those that share a vec_id, the least label and vector."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    known = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    q = F.transform(v, lambda x: F.floor(x * SCALE).cast("double"))
    rows = known.select(F.col(vec_id).cast("long").alias("vec_id"), F.struct(F.col(label).cast("long").alias("label"), q.alias("q")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q")


def _matrix(rows: pd.Series | list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid, and its distance."""
    near = ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
    return near, np.sqrt(((x - c[near]) ** 2).sum(axis=1))


def fitted(rows: DataFrame, n: int, width: int, seed: int = 42) -> np.ndarray:
    """k-means on a bounded sample (the rows of the least hashes), by Lloyd's rounds; it decides the cost of a search, never its results."""
    size = max(1, TRAIN_NUMBERS // width)
    k = max(1, min(math.isqrt(n), CENTROID_NUMBERS // width, size // 4))
    x = _matrix([r["q"] for r in rows.select("q", F.xxhash64(F.lit(seed), "vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(size).collect()], width)
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ITERATIONS):
        near = np.concatenate([nearest(part, c)[0] for part in np.array_split(x, len(x) // 2048 + 1)])
        sums, sizes = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    return c


def bounds(anchors: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor the lists by descending upper bound of scores: their positions, upper and lower bounds.

    Whatever a list holds lies within its radius of the centroid, so that by Cauchy-Schwarz a score differs from the
    centroid's by the anchor's length times the radius at most (and some room for rounding).
    """
    middle, spread = anchors @ centroids.T, np.sqrt((anchors * anchors).sum(axis=1))[:, None] * radii[None, :]
    room = 1e-9 * (np.abs(middle) + spread) + 1e-6
    upper, lower = middle + spread + room, middle - spread - room
    by = np.argsort(-upper, axis=1, kind="stable")
    return by, np.take_along_axis(upper, by, 1), np.take_along_axis(lower, by, 1)


def _packed(df: DataFrame, size: int, salts: int, kinds: dict[str, str], width: int) -> DataFrame:
    """Rows (cluster, id, q, ...) as blocks of at most `size` rows of one cluster: cluster, ids, vectors (a matrix's bytes), ...

    Rows are dealt by cluster and salt, so that no task has to take all of a large cluster, and a task holds one block.
    """

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        plain = lambda x: x.tolist() if hasattr(x, "tolist") else x
        first = {"cluster": [rows["cluster"].iloc[0]], "ids": [rows["id"].tolist()], "vectors": [_matrix(rows["q"], width).tobytes()]}
        return pd.DataFrame(first | {c: [[plain(x) for x in rows[c]]] for c in kinds})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for x in batches:
            x = x if rest is None else pd.concat([rest, x], ignore_index=True)
            blocks = [rows.iloc[i : i + size] for _, rows in x.groupby("cluster", sort=False) for i in range(0, len(rows), size)]
            # The last block may go on in the next batch.
            rest = blocks.pop() if blocks else None
            yield from map(block, blocks)
        if rest is not None:
            yield block(rest)

    schema = "cluster int, ids array<long>, vectors binary" + "".join(f", {c} array<{kind}>" for c, kind in kinds.items())
    dealt = df.select("cluster", "id", "q", *kinds).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    return dealt.repartition("cluster", "_salt").sortWithinPartitions("cluster", "id").drop("_salt").mapInPandas(pack, schema)


class Index:
    """Every row in the list of its nearest centroid: a table of blocks, and of each list its centroid, radius and number of keys.

    What the driver holds is bounded by CENTROID_NUMBERS; the blocks are written to the shared folder.
    """

    def __init__(self, rows: DataFrame, scope: str = ""):
        spark, self.scope = rows.sparkSession, scope
        of = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
        self.n, self.width = of["n"], max(1, of["width"] or 0)
        self.block, self.chunk = max(1, BLOCK_NUMBERS // self.width), max(1, CHUNK_NUMBERS // self.width)
        if (of["norm"] or 0) * self.block >= 2.0**53:
            raise ValueError("the vectors are too long for exact scores")
        if not self.n:
            return
        centroids, width = fitted(rows, self.n, self.width), self.width
        shared = spark.sparkContext.broadcast(centroids)

        @F.pandas_udf("cluster int, apart double")
        def place(q: pd.Series) -> pd.DataFrame:
            near, apart = nearest(_matrix(q, width), shared.value)
            return pd.DataFrame({"cluster": near.astype(np.int32), "apart": apart})

        placed = saved(rows.select(F.col("vec_id").alias("id"), "label", "q", place("q").alias("p")).select("id", "label", "q", "p.*"), "negatives-placed", scope)
        lists = {r["cluster"]: (r["radius"], r["n"]) for r in placed.groupBy("cluster").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect()}
        self.used = np.array(sorted(lists), np.int32)
        self.centroids, self.radii = centroids[self.used], np.array([lists[k][0] for k in self.used])
        # A list of many blocks is dealt to several keys.
        keys = [math.ceil(lists[k][1] / (self.block * BLOCKS_A_KEY)) for k in self.used]
        self.keys = spark.createDataFrame([(int(k), s) for k, s in zip(self.used, keys, strict=True)], "cluster int, n_keys int")
        packed = _packed(placed, self.block, max(keys), {"label": "long"}, width).join(F.broadcast(self.keys), "cluster")
        key = F.pmod(F.xxhash64(F.get("ids", F.lit(0)), F.size("ids")), F.col("n_keys")).cast("int")
        self.blocks = saved(packed.select("cluster", key.alias("key"), "ids", "label", "vectors"), "negatives-lists", scope)

    def visits(self, state: DataFrame, done: int, upto: int) -> DataFrame:
        """Rows of state (id, label, q, goals) by cluster: the lists from rank `done` to `upto` that may change what an anchor has.

        A list whose upper bound is strictly below a goal's `least` is out, as are all after it; one whose lower bound is above
        its `most` lies outside the window and is skipped.
        """
        width, shared = self.width, state.sparkSession.sparkContext.broadcast((self.centroids, self.radii, self.used))

        @F.pandas_udf("array<int>")
        def pick(q: pd.Series, goals: pd.Series) -> pd.Series:
            centroids, radii, used = shared.value
            out = []
            for i in range(0, len(q), 256):
                each = zip(*bounds(_matrix(q.iloc[i : i + 256], width), centroids, radii), goals.iloc[i : i + 256], strict=True)
                for by, upper, lower, wants in each:
                    wanted = np.zeros(upto - done, bool)
                    for g in wants:
                        wanted |= (upper[done:upto] >= g["least"]) & (lower[done:upto] <= g["most"])
                    out.append(used[by[done:upto][wanted]])
            return pd.Series(out, dtype=object)

        return state.select("id", "label", "q", "goals", F.explode(pick("q", "goals")).alias("cluster"))


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of each (id, goal) by descending score, then id; Spark keeps k in each task before it shuffles."""
    w = Window.partitionBy("id", "goal").orderBy(F.desc("score"), "other")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def searched(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """The first k rows that each goal of each anchor allows, by descending score, then id: id, goal, score, other, rank.

    anchors: id, label, q, goals (goal, least, most). same: rows of the anchor's label but itself; else rows of other
    labels. In rounds, each anchor visits the next lists in the order of their bounds; the kth score that it then has
    becomes its `least`, and it stops when all bounds that are left are strictly below.
    """
    scope, n = index.scope, len(index.used)
    state = saved(anchors.select("id", "label", "q", F.col("goals").cast(GOALS).alias("goals"), F.array().cast("array<struct<goal: int, score: double, other: long>>").alias("found")), "negatives-state", scope)
    done, step = 0, FIRST
    while done < n:
        upto = min(n, done + step)
        chunks = _packed(index.visits(state, done, upto), index.chunk, 16, {"label": "long", "goals": GOALS}, index.width).join(F.broadcast(index.keys), "cluster")
        # Large lists have several keys; a chunk of anchors goes to all of them.
        chunks = chunks.select("cluster", F.explode(F.sequence(F.lit(0), F.col("n_keys") - 1)).alias("key"), *(F.col(c).alias(f"a_{c}") for c in ("ids", "vectors", "label", "goals")))
        new = chunks.join(index.blocks, ["cluster", "key"]).drop("cluster", "key").mapInPandas(_scan(index.width, k, same), "id long, goal int, score double, other long")
        known = state.select("id", F.inline("found")).select("id", "goal", "score", "other")
        best = _first(new.unionByName(known), k)
        each = best.groupBy("id", "goal").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"), F.collect_list(F.struct("goal", "score", "other")).alias("has"))
        each = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("goal", "kth"))).alias("kth"), F.flatten(F.collect_list("has")).alias("has"))
        raised = F.transform("goals", lambda g: F.struct(g.goal.alias("goal"), F.greatest(g.least, F.try_element_at("kth", g.goal)).alias("least"), g.most.alias("most")))
        state = state.join(each, "id", "left").select("id", "label", "q", F.when(F.col("kth").isNull(), F.col("goals")).otherwise(raised).alias("goals"), F.coalesce("has", "found").alias("found"))
        state = saved(state, "negatives-state", scope)
        done, step = upto, step * GROWTH
    return _first(state.select("id", F.inline("found")), k)


def _scan(width: int, k: int, same: bool):
    """Scores of a chunk of anchors with a block of a list: of each goal the first k. Sums of whole numbers, so exact."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = row = None
        for x in batches:
            for r in x.itertuples(index=False):
                if (r.a_vectors, list(r.a_ids)) != last:
                    last = (r.a_vectors, list(r.a_ids))
                    a, a_ids, a_label = np.frombuffer(r.a_vectors).reshape(-1, width), np.asarray(r.a_ids, np.int64), np.asarray(r.a_label, np.int64)
                    row = np.repeat(np.arange(len(a)), [len(goals) for goals in r.a_goals])
                    goal, least, most = (np.array([g[c] for goals in r.a_goals for g in goals]) for c in ("goal", "least", "most"))
                ids, label = np.asarray(r.ids, np.int64), np.asarray(r.label, np.int64)
                scores = a @ np.frombuffer(r.vectors).reshape(-1, width).T
                fits = a_label[:, None] == label[None, :]
                fits = fits & (a_ids[:, None] != ids[None, :]) if same else ~fits
                # Equal scores go by the smaller id: one whole number tells both.
                place = np.empty(len(ids))
                place[np.argsort(-ids, kind="stable")] = np.arange(len(ids))
                inside = fits[row] & (scores[row] >= least[:, None]) & (scores[row] <= most[:, None])
                some = np.flatnonzero(inside.any(axis=1))
                if not len(some):
                    continue
                keys = np.where(inside[some], scores[row[some]] * len(ids) + place, -np.inf)
                best = np.argpartition(-keys, k - 1, axis=1)[:, :k] if k < len(ids) else np.broadcast_to(np.arange(len(ids)), keys.shape)
                i, j = np.repeat(some, best.shape[1]), best.ravel()
                i, j = i[inside[i, j]], j[inside[i, j]]
                yield pd.DataFrame({"id": a_ids[row[i]], "goal": goal[i].astype(np.int32), "score": scores[row[i], j], "other": ids[j]})

    return scan


def _hundredths(x: Column) -> Column:
    """floor(x / 100) of a whole number, exactly, as double."""
    return (x - F.pmod(x, F.lit(100))) / F.lit(100.0)


def hard_negatives(
    df: DataFrame, anchors: Column, *, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scope: str = ""
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors: a condition on vec_id that tells the anchors. Their positives are the first other rows of the same label
    by integer inner product, ties by vec_id; for each, the negatives are the first rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score. Below zero, that window is empty.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. vec_id is a key: of rows that
    share it, equal or not, the one with the least label and vector counts. Shorter vectors are filled with zeros. An empty
    table, or one without anchors, gives no rows. Other columns of df have no part in it. Scores are exact; vectors
    so long that sums of products might not be are an error. All rows are searched: clusters only order and bound.
    """
    rows = saved(usable(df, vec_id, label, vector), "negatives-rows", scope)
    index = Index(rows, scope)
    if not index.n:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = rows.where(anchors).select(F.col("vec_id").alias("id"), "label", "q")
    every = F.array(F.struct(F.lit(0).alias("goal"), F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most")))
    first = searched(index, asked.withColumn("goals", every), positives, same=True)
    first = saved(first.select("id", F.col("rank").alias("goal"), F.col("other").alias("positive_id"), F.col("score").cast("long").alias("positive_score")), "negatives-positives", scope)
    lo, hi = _hundredths(F.col("positive_score") * least + 99), _hundredths(F.col("positive_score") * most)
    goals = first.where(lo <= hi).groupBy("id").agg(F.collect_list(F.struct("goal", lo.alias("least"), hi.alias("most"))).alias("goals"))
    found = searched(index, asked.join(goals, "id"), negatives, same=False)
    out = found.join(first, ["id", "goal"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
