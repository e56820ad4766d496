"""Cases in which a shortcut would lose part of the job."""

import numpy as np

from foliant.llm import mixing, simhash, substrings, warc, words


def test_near_duplicates_in_large_sets(spark):
    """Sixty pairs of similarity 0.802, all with one passage by which texts of different pairs have 0.77."""
    passage = [f"p{i}" for i in range(178)]
    texts = [(2 * i + j, " ".join(passage + [f"q{i}x{k}" for k in range(4)] + [f"r{i}x{j}x{k}" for k in range(22)])) for i in range(60) for j in (0, 1)]
    kept = simhash.without_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 120, 2))


def test_short_sentences_behind_a_long_one(spark):
    """Sentences of 30, 6 and 5 words repeat; what stands around them differs."""
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n)) + "."
    passage = " ".join(run(name, n) for name, n in (("a", 30), ("b", 6), ("c", 5)))
    frame = spark.createDataFrame([(i, f"{run(f'x{i}y', 25)} {passage} {run(f'z{i}y', 25)}") for i in (1, 2)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in substrings.without_repeats(frame).collect()}
    assert passage in clean[1] and clean[2] == f"{run('x2y', 25)} {run('z2y', 25)}"


def _brute_kept(texts, k=5, similarity=0.8):
    """doc_ids that stay, by comparing all pairs."""
    sets = {d: set(zip(*(t.lower().split()[i:] for i in range(k)), strict=False)) for d, t in texts}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [d for d in ids if find(d) == d]


def test_near_duplicates_of_a_lost_origin(spark):
    """Texts of 120 words around one passage that stands alone nowhere: many links, none of them with a common head."""
    rng = np.random.default_rng(4)
    base = [f"p{i}" for i in range(120)]
    texts = []
    for d in range(500):
        words, edits = list(base), rng.integers(1, 6)
        for at in rng.integers(0, 120, edits):
            words[at] = f"e{rng.integers(0, 40)}"
        texts.append((d, " ".join(words)))
    want = _brute_kept(texts)
    assert 1 < len(want) < 490
    kept = simhash.without_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_word_hashes():
    text = "One  two\tTHREE\nfour " + "x" * 200_000 + " five é " * 20_000
    h = words.word_hashes(text)
    plain = [w.lower() for w in text.split()]
    assert len(h) == len(plain) and len(dict(zip(plain, h.tolist(), strict=True))) == len(set(h.tolist())) == len(set(plain))
    assert len({(w, x) for w, x in zip(plain, h.tolist(), strict=True)}) == len(set(plain))
    assert (words.word_hashes("one TWO three") == h[:3]).all() and len(words.word_hashes(None)) == len(words.word_hashes(" \n")) == 0
    runs = words.shingle_hashes(text, 5)
    assert len(runs) == len(plain) - 4 and len(set(runs.tolist())) == len(set(zip(*(plain[i:] for i in range(5)), strict=False)))
    assert len(words.shingle_hashes("a b", 5)) == 1 and words.shingle_hashes("a b", 5)[0] != words.shingle_hashes("b a", 5)[0]


def test_repeats_under_one_id(spark):
    """Texts that share a doc_id, or have none, are cut by their own repeats only."""
    long = "First sentence has five words. Second sentence has five words. Third sentence has five words. Fourth sentence has five words."
    other = "This one is its own. It stands nowhere else at all. Third here. Fourth here. Fifth."
    for ids in ((1, 7, 7), (1, None, None)):
        frame = spark.createDataFrame([(ids[0], long), (ids[1], long), (ids[2], other)], "doc_id long, text string")
        assert sorted(r.text for r in substrings.without_repeats(frame).collect()) == sorted([long, "", other])


def test_repeat_of_one_long_sentence(spark):
    """A sentence of 80 words is several, cut alike wherever it stands."""
    line = " ".join(f"word{i}" for i in range(80))
    assert len(substrings.sentences(line)) > 2
    frame = spark.createDataFrame([(1, line), (2, "Before it " + line + " and after"), (3, "Short.")], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in substrings.without_repeats(frame).collect()}
    assert clean[1] == line and clean[3] == "Short." and len(clean[2].split()) < 40


def test_mix_of_equal_rows(spark):
    """Rows without doc_ids, distinct or equal, come near the target as well."""
    for text in (lambda i: "one two three", lambda i: f"one two {i}"):
        frame = spark.createDataFrame([(None, text(i), "a") for i in range(100)] + [(1, "x " * 150, "b")], "doc_id long, text string, source string")
        out = mixing.mix(frame, weights=(2, 1), budget=1.0).collect()
        taken = sum(r["size"] * r.repetitions for r in out if r.source == "a")
        assert len(out) == 101 and {r.target for r in out if r.source == "a"} == {300.0} and abs(taken - 300) <= 3
        out = mixing.mix(frame, weights=(1, 1), budget=1.0).collect()
        assert abs(sum(r["size"] * r.repetitions for r in out if r.source == "a") - 225) <= 3


def test_dictionary_in_every_archive(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for parts in (16, 64):
        path = warc.write_archives(pages.repartition(parts))
        archives = spark.read.parquet(path).collect()
        assert len(archives) > 10 and all(bytes(a.content[:4]) == bytes.fromhex("5d2a4d18") for a in archives)
        assert warc.read_archives(spark, path).count() == pages.count()
