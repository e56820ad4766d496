"""Each query against a brute-force version, on the smallest data."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import language, licenses, mixing, sharding, substrings
from foliant.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOW))
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op1(spark, sf, docs):
    """All runs of sentences, of any length, in place of the shortest ones that the library hashes."""
    places, cut = defaultdict(list), {}
    for d, text in sorted(zip(docs.doc_id, docs.text, strict=True)):
        cut[d] = [" ".join(text[a:b].split()) for a, b in substrings.sentences(text)]
        lines, size = cut[d], [len(x.split()) for x in cut[d]]
        for i in range(len(lines)):
            for j in range(i + 1, min(i + 40, len(lines))):
                if sum(size[i : j + 1]) >= substrings.MIN_WORDS:
                    places[hash("\n".join(lines[i : j + 1]))].append((d, i, j))
    removed = defaultdict(set)
    for found in places.values():
        for d, i, j in found[1:]:
            removed[d] |= set(range(i, j + 1))
    got = defaultdict(set)
    for r in rows(spark, sf, "op1_substrings"):
        got[r.doc_id] |= set(range(r.first_sentence, r.last_sentence + 1))
        assert r.n_sentences == r.last_sentence - r.first_sentence + 1 and r.first_doc_id <= r.doc_id
    assert got == removed


def test_op2(spark, sf, docs):
    out = rows(spark, sf, "op2_mixing")
    size = {d: len(WORD.findall(t or "")) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    by = defaultdict(int)
    for d, s in zip(docs.doc_id, docs.source, strict=True):
        by[s] += size[d]
    names = sorted(by)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(by.values())
    while True:
        level = (budget - sum(2 * by[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level > 2 * by[s]}
        if not more:
            break
        full |= more
    target = {s: 2 * by[s] if s in full else weight[s] * level for s in names}
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == by[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-9) and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    assert sorted(map(tuple, out)) == sorted(map(tuple, rows(spark, sf, "op2_mixing")))


def test_op3(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    first = {}
    for p, html in sorted(zip(pages.page_id, pages.html, strict=True)):
        first.setdefault(html, p)
    want = set()
    for p, html in zip(pages.page_id, pages.html, strict=True):
        raw = (html or "").encode()
        again = first[html] != p
        want.add((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html] if again else None))
    assert {tuple(r) for r in rows(spark, sf, "op3_warc")} == want


def test_op4(spark, sf):
    from foliant.llm.urls import RULES

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = rows(spark, sf, "op4_urls")
    assert len(out) == len(urls)
    for r in out:
        m = re.search(r"^(?s:.*?)://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fits = [(len(x), x, a) for a, x in RULES for h, p in [(x.split("/")[0], x[x.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_op5(spark, sf, docs):
    out = rows(spark, sf, "op5_sharding")
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    shard, slots, total = {}, defaultdict(list), Counter()
    for r in out:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert shard.setdefault(text[r.doc_id], r.shard) == r.shard
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert max(total.values()) == capacity([hashlib.sha256(t.encode()).digest() for t in docs.text], [len(t.encode()) + 16 for t in docs.text])


def _sums(out):
    total = Counter()
    for r in out:
        total[r.shard] += len(r.text.encode()) + 16
    return total


def capacity(keys, weights):
    """The smallest capacity of 40 shards, by trying them in order of the groups' keys."""
    groups = defaultdict(int)
    for key, weight in zip(keys, weights, strict=True):
        groups[key] += weight
    sizes = [groups[g] for g in sorted(groups)]

    def fits(most):
        n, fill = 1, 0
        for s in sizes:
            if s > most:
                return False
            n, fill = (n + 1, s) if fill + s > most else (n, fill + s)
        return n <= 40

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("held", [8, 64])
def test_sharding_in_refinements(spark, sf, held):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    coarse = sharding.shard(frame, 7, ends_held=held).groupBy("shard").sum("size").collect()
    fine = sharding.shard(frame, 7).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in coarse) == max(r[1] for r in fine)


def test_op6(spark, sf, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in rows(spark, sf, "op6_licenses"):
        words = word.findall(text[r.doc_id].translate(LOW))
        places = sorted((i, label) for p, label in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op7(spark, sf, docs):
    lang = dict(zip(docs.doc_id, docs.lang, strict=True))
    out = rows(spark, sf, "op7_language")
    assert {r.doc_id for r in out} == set(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op8(spark, sf, docs):
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in rows(spark, sf, "op8_media"):
        raw = text[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_op9(spark, sf, docs):
    want = set()
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        own = set(shingles(item.text, 5))
        for d, text in zip(docs.doc_id, docs.text, strict=True):
            shared = len(own & set(shingles(text, 5)))
            if shared >= 0.8 * len(own):
                want.add((d, item.item_id, shared, len(own)))
    assert want and {(r.doc_id, r.item_id, r.shared, r.shingles) for r in rows(spark, sf, "op9_decontamination")} == want


def test_op10(spark, sf, docs):
    fp = {}
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
        fp[d] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))
    ids = sorted(fp)
    root = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {tuple(r) for r in rows(spark, sf, "op10_simhash")} == {(d, f"{fp[d]:016x}", root[d]) for d in ids}


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    one = p.language_id(spark, frame, sf)
    assert one.columns == frame.columns and one.count() >= 0.98 * len(docs)
    kept = {r.doc_id for r in p.near_dedup(spark, frame, sf).collect()}
    sets = {d: set(shingles(t, 5)) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert near and kept == set(roots(ids, near).values())
    items = [set(shingles(r.text, 5)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in p.decontaminate(spark, frame, sf).collect()}
    assert clean == {d for d in ids if not any(len(i & sets[d]) >= 0.8 * len(i) for i in items)}
    repeats = Counter(r.doc_id for r in p.mix(spark, frame, sf).collect())
    assert repeats == {r.doc_id: r.repetitions for r in QUERIES["op2_mixing"](spark, sf).collect() if r.repetitions}
    # The stages on one another, each held against brute force on its own input.
    out = p.run(spark, sf).collect()
    first = {r.doc_id for r in one.collect()}
    kept = set(roots(sorted(first), [(a, b) for a, b in near if a in first and b in first]).values())
    clean = {d for d in kept if not any(len(i & sets[d]) >= 0.8 * len(i) for i in items)}
    mixed = {r.doc_id: r.repetitions for r in mixing.mix(frame.where(F.col("doc_id").isin(clean))).collect() if r.repetitions}
    assert Counter(r.doc_id for r in out) == mixed and {r.shard for r in out} <= set(range(40))
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    assert all(r.text == text[r.doc_id] for r in out) and len({(r.text, r.shard) for r in out}) == len({r.text for r in out})
    assert capacity([hashlib.sha256(r.text.encode()).digest() for r in out], [len(r.text.encode()) + 16 for r in out]) == max(Counter(_sums(out)).values())


def test_language_words_then_grams():
    model = language.Model({("haus", "de"): 9, ("maison", "fr"): 9, ("und", "de"): 5, ("et", "fr"): 5})
    scorer = language.Scorer(model)
    assert scorer.predict("Das Haus")[0] == "de" and scorer.predict("maisonette")[0] == "fr"
    assert scorer.predict(None) == ("und", 0.0) and scorer.predict("123 !?") == ("und", 0.0)
    # Numbers that aren't decimal, and marks, are no letters, as in training.
    assert scorer.predict("² ½ Ⅷ ① ٣ \u0301") == ("und", 0.0) and language.word_counts("x²y Haus") == {"x": 1, "y": 1, "haus": 1}


def test_language_scores():
    """Scores against a plain version that adds up logs word by word; a small memory changes nothing."""
    import math

    learned = Counter({("haus", "de"): 9, ("hauses", "de"): 2, ("maison", "fr"): 9, ("und", "de"): 5, ("et", "fr"): 5, ("rare", "fr"): 1})
    model = language.Model(learned)
    langs = ["de", "fr"]
    known = {w: [learned[w, x] for x in langs] for w, _ in learned}
    grams = defaultdict(lambda: [0, 0])
    for (w, x), n in learned.items():
        for k in range(1, 5):
            for i in range(len(w) + 3 - k):
                grams[f" {w} "[i : i + k]][langs.index(x)] += n

    def logs(table, own):
        return {w: [math.log((c + 0.1) / (sum(table[v][i] for v in own(w)) + 0.1 * len(own(w)))) for i, c in enumerate(table[w])] for w in table if sum(table[w]) >= 2}

    words, parts = logs(known, lambda _: list(known)), logs(grams, lambda g: [h for h in grams if len(h) == len(g)])

    def score(word):
        if word in words:
            return words[word]
        total, padded = [0.0, 0.0], f" {word} "
        for i in range(len(padded)):
            g = next((padded[i : i + k] for k in range(4, 0, -1) if padded[i : i + k] in parts), None)
            if g:
                total = [t + x - max(parts[g]) - (4 - len(g)) * math.log(2) for t, x in zip(total, parts[g], strict=True)]
        return total

    scorer = language.Scorer(model)
    for text in ("haus maison et hausen", "maisons et hauses", "rare zzz", "un hau", "haus " * 30 + "maison"):
        each = [score(w) for w in text.split()]
        total = [sum(x[i] for x in each) * min(1, 20 / len(each)) for i in (0, 1)]
        best = max((0, 1), key=lambda i: total[i])
        got = scorer.predict(text)
        assert got[0] == langs[best] and got[1] == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total))
