"""Similarity join, hard negatives and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import infill, jaccard, negatives
from foliant.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names the operators use themselves.
EXTRA = ("id", "hash", "size", "sigs", "row", "n", "form", "output", "h1", "c", "cluster", "goals", "q", "r", "found", "rank")


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOW))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {" ".join(words)} - {""}


def linked(texts, percent=80):
    """component by position, and sizes, by all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("percent", [60, 80, 95, 100])
def test_signatures_of_similar_sets(percent):
    rng = np.random.default_rng(percent)
    similar = 0
    for n in [*range(1, 40), 64, 101, 102, 163, 640, 1023, 1024, 1500] * 12:
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        most = n * (100 - percent) // percent
        away = rng.integers(0, most + 1)
        y = np.unique(np.concatenate([x[: n - away], rng.integers(0, 1 << 63, rng.integers(0, most - away + 1), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= percent * (n + len(y) - shared):
            similar += 1
            assert len(np.intersect1d(jaccard.signatures(np.unique(x), percent), jaccard.signatures(y, percent)))
    assert similar > 100


def test_op11(spark, sf):
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    roots, sizes = linked([t for _, t in docs])
    want = {(d, n, docs[r][0]) for (d, _), n, r in zip(docs, sizes, roots, strict=True)}
    assert {tuple(r) for r in QUERIES["op11_jaccard"](spark, sf).collect()} == want


def _stock(n, seed=3):
    rng = random.Random(seed)
    paragraphs = [" ".join(f"{p}x{rng.randrange(10**6)}" for _ in range(12)) for p in range(12)]
    texts = [" ".join(rng.sample(paragraphs, 6)) for _ in range(n)]
    origin = " ".join(f"o{i}" for i in range(120)).split()
    for i in range(n // 2):  # copies with a few words changed
        words = origin.copy()
        for j in rng.sample(range(120), i % 5):
            words[j] = f"n{i}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("crowd", [0, 4])
def test_crowds_of_texts(spark, crowd, monkeypatch):
    """Texts of few stock paragraphs and a group of near copies; crowd 0: all that meet must share a first shingle too."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    texts = _stock(60)
    roots, _ = linked(texts)
    out = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(out)] == roots


def test_one_key_for_the_same_texts(spark):
    """Of keys that the very same texts have the first one stays; those of one root only go."""
    rows = [("late", i, i, 5) for i in (1, 2, 3)] + [("early", i, i, 2) for i in (1, 2, 3)] + [("other", i, i, 2) for i in (1, 2)] + [("own", i, 9, 0) for i in (4, 5)]
    found = jaccard._open_keys(spark.createDataFrame(rows, "shingle string, id long, root long, at int"), "shingle")
    assert sorted(map(tuple, found.collect())) == [("early", False), ("other", False)]


def test_shingles_of_one_text_make_no_rows(spark):
    """Of first shingles, those that one text alone has go before rows are made of them; those of two texts stay in both, at their places."""
    texts = [" ".join(f"{i}w{j}" for j in range(100)) for i in range(60)]
    texts.append(texts[0] + " more")
    found = jaccard.Texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 5, 80, "")
    near = [found.rows.where(f"doc_id = {i}").first().id for i in (0, 60)]
    rows = found._first_shingles(found.rows.select("id", F.col("id").alias("root"), "size")).collect()
    of = [{r.shingle: r.at for r in rows if r.id == i} for i in near]
    both = set(of[0]) & set(of[1])
    # The rare ones come first: the one that the longer text alone has is at its first place, where no row is.
    assert len(both) >= 19 and {of[1][x] for x in both} <= set(range(1, 21)) and {r.root for r in rows if r.id in near} == set(near)
    assert len([r for r in rows if r.id not in near]) < 60


def test_jaccard_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A  B\tc d\ne F"), (3, None), (4, ""), (5, " \n"), (6, "a b"), (7, "A b"), (8, "b a"), (None, "x y"), (None, "p q"), (9, "x y"), (10, long), (11, long + " end"), (12, "é ü"), (13, "É ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in EXTRA))
    out = sorted(jaccard.jaccard_components(df).collect(), key=str)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == [
        (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9), (10, 977, 10), (11, 978, 10), (12, 1, 12), (13, 1, 13),
    ]
    assert sorted((r.n_shingles, r.component_id or -1) for r in out if r.doc_id is None) == [(1, -1), (1, 9)]
    assert jaccard.jaccard_components(df.limit(0)).collect() == []


def mined(rows, anchor, positives=5, negatives=3):
    """All pairs, in whole numbers of Python."""
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = set()
    for a, (label, v) in q.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in q.items() if i != a}
        by = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in by if q[i][0] == label][:positives]:
            fits = [i for i in by if q[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(fits, 1)}
    return out


def test_op12(spark, sf):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, v, label in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect() if label is not None and v is not None]
    got = QUERIES["op12_negatives"](spark, sf).collect()
    assert got and {tuple(r) for r in got} == mined(rows, lambda i: i % 50 == 0) and len(got) == len({tuple(r) for r in got})


def test_negatives_of_clustered_rows(spark, monkeypatch):
    """Small blocks, many keys and rounds; clusters that bounds rule out; ties."""
    for name, value in (("BLOCK_NUMBERS", 16), ("CHUNK_NUMBERS", 12), ("BLOCKS_A_KEY", 2), ("FIRST", 1), ("GROWTH", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 4)) * 4
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.round(centres[i % 6] + rng.normal(size=4) * 0.05, 1)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    assert got and {tuple(r) for r in got} == mined(rows, lambda i: i % 10 == 0)


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.75, 0.1]), (3, 2, [0.75, 0.1]), (4, 2, [0.75]), (5, 1, [-1.0, 0.0]), (100, 3, [0.0, 1.0])]
    odd = [(6, None, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (7, 2, None), (8, 2, [nan, 0.0]), (9, 2, [inf, 0.0]), (10, 2, [None, 1.0]), (1, 1, [1.0, 0.5]), (2, 9, [0.9, 0.9])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label long, embedding array<double>").select("*", *(F.lit(1).alias(c) for c in EXTRA))
    anchors = F.col("vec_id") % 50 == 0
    got = {tuple(r) for r in negatives.hard_negatives(df, anchors).collect()}
    assert got == mined(rows, lambda i: i % 50 == 0) and {r[3] for r in got} == {2, 3, 4}
    assert negatives.hard_negatives(df.limit(0), anchors).collect() == []
    assert negatives.hard_negatives(df.where("vec_id < 50"), anchors).collect() == []
    one = spark.createDataFrame([(50, 1, [])], "vec_id long, label long, embedding array<double>")
    assert negatives.hard_negatives(one, anchors).collect() == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(50, 1, [1e9])], "vec_id long, label long, embedding array<double>"), anchors)


def infilled(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_op13(spark, sf):
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for d, t in docs:
        *found, output = infilled(d, t)
        want.add((d, *found, sha(output), sha(t)))
    assert {tuple(r) for r in QUERIES["op13_infill"](spark, sf).collect()} == want


def test_infill_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000)) + " \n"
    texts = [None, "", " \t\n", "one", " one  two\nthree ", "a <P> b", "a < P> <S", "<M>", "\U0001f600 漢 字 é x", "<" * 9 + " S> M>", long]
    rows = [(i, t) for i in range(40) for t in texts] + [(None, "one two three"), (None, "one two three"), (3, "one"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in EXTRA))
    out = infill.transformed(df)
    back = out.select("*", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=key) == sorted(((d, *infilled(d, t)) for d, t in rows), key=key)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert infill.transformed(df.limit(0)).collect() == []
    for bad in (("a", "a", "b"), ("<P>", "<S>", "S>"), ("<P", "<P>", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.transformed(df, markers=bad)
