"""URL templates against a plain tree over the given pages; repeated passages of long sentences and unspaced scripts."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliant.llm import substrings, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verdicts(pages, rules):
    """A tree of dicts, one page after the other; merged and judged as the operator says."""
    parsed = []
    for page_id, url in pages:
        m = re.search(r"^(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fits = [(len(x), x, a) for a, x in rules for h, p in [(x.partition("/")[0], "/" + x.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed.append((page_id, host, [s for s in path.split("/") if s], max(fits)[2] if fits else None))

    def shape(segment):
        return next((name for pattern, name in urls.SHAPES if re.search(pattern, segment)), None)

    templates = {}

    def grow(prefix, here, level):
        inner = [i for i in here if len(parsed[i][2]) > level]
        for i in here:
            if len(parsed[i][2]) <= level:
                templates[i] = prefix
        if len(inner) < urls.SUPPORT:
            for i in inner:
                templates[i] = (*prefix, "{rest}")
            return
        words = Counter(parsed[i][2][level] for i in inner if shape(parsed[i][2][level]) is None)
        branches = defaultdict(list)
        for i in inner:
            w = parsed[i][2][level]
            often = words[w] >= urls.SUPPORT and words[w] >= len(inner) * urls.SHARE
            branches[shape(w) or (w if often else "{word}")].append(i)
        for name, some in branches.items():
            grow((*prefix, name), some, level + 1)

    hosts = defaultdict(list)
    for i, (_, host, _, _) in enumerate(parsed):
        hosts[host].append(i)
    for some in hosts.values():
        grow((), some, 0)
    good, bad = Counter(), Counter()
    for i, (_, host, _, action) in enumerate(parsed):
        good[host, templates[i]] += action == "allow"
        bad[host, templates[i]] += action == "block"
    merged = {k: k[1] for k in good}
    for level in reversed(range(max(len(t) for t in merged.values()))):
        families = defaultdict(lambda: [0, 0])
        for k, t in merged.items():
            if len(t) > level and not t[level].startswith("{"):
                families[k[0], t][0] += good[k]
                families[k[0], t][1] += bad[k]
        siblings = defaultdict(list)
        for (host, t), (g, b) in families.items():
            siblings[host, t[:level], t[level + 1 :], g + b == 0].append((b / (g + b) if g + b else 0.0, t[level], g + b, t))
        named = {}
        for (host, before, after, _), group in siblings.items():
            group.sort()
            runs = [[group[0]]]
            for (r0, _, n0, _), x in zip(group, group[1:]):
                pooled = (x[0] * x[2] + r0 * n0 + 0.5) / (x[2] + n0 + 1) if x[2] else 0
                splits = x[2] and x[0] - r0 > urls.STANDARD_ERRORS * math.sqrt(pooled * (1 - pooled) * (1 / x[2] + 1 / n0))
                runs.append([x]) if splits else runs[-1].append(x)
            for run in runs:
                if len(run) > 1:
                    named |= {(host, x[3]): (*before, "{like " + min(y[1] for y in run) + "}", *after) for x in run}
        merged = {k: named.get((k[0], t), t) for k, t in merged.items()}
    total = lambda keys: (sum(bad[k] for k in keys), sum(bad[k] + good[k] for k in keys))
    smooth = lambda b, n, above: (b + urls.SMOOTHING * above) / (n + urls.SMOOTHING)
    b, n = total(merged)
    prior = b / n if n else 0.0
    rejected = set()
    for k, t in merged.items():
        host = smooth(*total([x for x in merged if x[0] == k[0]]), prior)
        top = smooth(*total([x for x in merged if x[0] == k[0] and merged[x][:1] == t[:1]]), host)
        if smooth(*total([x for x in merged if x[0] == k[0] and merged[x] == t]), top) >= urls.REJECT:
            rejected.add(k)
    return sorted(((p, a or ("block" if (host, templates[i]) in rejected else "allow")) for i, (p, host, _, a) in enumerate(parsed)), key=str)


def test_verdicts_of_the_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    out = urls.judge(pages, urls.RULES).select("page_id", "verdict").collect()
    assert sorted(map(tuple, out), key=str) == verdicts([tuple(r) for r in pages.collect()], urls.RULES)


def test_verdicts_of_made_trees(spark):
    """Branches of all kinds and labels; repeated rows; a URL of thousands of segments, and one of one long segment."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        host = rng.choice(["a.com", "a.com", "b.a.com", "c.net"])
        word = rng.choice(["shop", "blog", "news", "forum", "wiki"])
        more = rng.choice(["", f"/{rng.randrange(99)}", f"/page-{rng.choice('abc')}", f"/x/{rng.choice(['good', 'bad', 'new'])}/p{i}.html", "/2024-01-02/some-long-title-of-it"])
        rows.append((i, f"http://{host}/{word}{more}"))
    rows += [(i % 50, u) for i, (_, u) in enumerate(rows[:60])] + [(2000, "http://a.com/" + "d/" * 3000), (2001, "http://a.com/" + "z" * 50_000), (2002, None)]
    rules = (("block", "a.com/forum"), ("allow", "a.com/wiki"), ("allow", "a.com/blog"), ("block", "c.net/news"), ("block", "a.com/shop/x/bad"), ("allow", "a.com/shop/x/good"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    for some in (rules, rules[:2], ()):
        out = urls.judge(df, some).select("page_id", "verdict").collect()
        assert sorted(map(tuple, out), key=str) == verdicts(rows, some)


def test_deep_paths_are_set_apart(spark, monkeypatch):
    """A few paths of 26 segments cost small tables of their own: the other paths are written at their own levels only."""
    rows = [(i, f"http://h.net/{'abcdefgh'[i % 8]}/{i}") for i in range(400)] + [(1000 + i, "http://trap.net/" + "/".join(f"s{j}" for j in range(26)) + f"/{i}") for i in range(20)]
    sizes = []
    kept = urls.saved

    def saved(df, name, *args, **kwargs):
        out = kept(df, name, *args, **kwargs)
        if name == "url-level":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(urls, "saved", saved)
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.judge(df, (("block", "trap.net/s0"),)).collect()
    assert len(out) == 420 and sizes[:2] == [420, 420] and set(sizes[2:]) == {20} and len(sizes) == 27


def found(texts):
    """Positions of documents of which the spans of another document repeat something."""
    seen, out = {}, set()
    for i, t in enumerate(texts):
        for h, _, _ in substrings.spans(t, substrings.MIN_SENTENCES, substrings.MIN_WORDS):
            if seen.setdefault(h, i) != i:
                out.add(i)
    return out


def test_copies_of_one_long_sentence():
    """Documents that are one sentence, each with its copy: none is missed."""
    for words in (40, 41, 49, 64, 96, 400):
        rng = random.Random(words)
        texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(words)) for _ in range(2000)]
        assert len(found(texts + texts)) == 2000


def test_passages_within_long_sentences():
    """Passages of 40 words and more, each in two long sentences that differ all around: every one is found."""
    rng = random.Random(1)
    some = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    for words in (40, 45, 60):
        passages = [some(words) for _ in range(500)]
        texts = [" ".join(some(rng.randrange(1, 40)) + p + some(rng.randrange(1, 40))) for p in passages for _ in "ab"]
        assert {i for i in found(texts) if i % 2} == set(range(1, 1000, 2))


def test_scripts_without_spaces():
    rng = random.Random(2)
    line = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) + "。"
    texts = ["".join(line(rng.randrange(5, 30)) for _ in range(200)) for _ in range(20)]
    assert len(substrings.sentences(texts[0])) >= 200 and len(found(texts + texts)) == 20 and not found(texts)
    # A passage of 45 characters in sentences that go on without a stop, and Thai without spaces.
    passage = line(45)[:-1]
    assert found([line(60)[:-1] + passage + line(60), line(50)[:-1] + passage + line(70)]) == {1}
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(60))
    assert found([thai, thai]) == {1} and [thai[a:b] for a, b in substrings.sentences(thai)] != [thai]
    assert "".join(texts[0][a:b] for a, b in substrings.sentences(texts[0])) == texts[0]


def test_cleaned_texts_of_both_kinds(spark):
    chinese, english = "今天天气很好我们去公园散步。" * 1 + "他说明天会下雨所以不出门了。" + "孩子们在院子里玩得非常高兴。", " ".join(f"word{i}" for i in range(60))
    rows = [(1, chinese), (2, "新的开头。" + chinese + "新的结尾。"), (3, english), (4, english), (5, None)]
    out = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: chinese, 2: "新的开头。新的结尾。", 3: english, 4: "", 5: None}
    assert substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").where(F.lit(False))).count() == 0
