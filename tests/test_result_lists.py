"""Results as lists: sound pages are read at once, those with an odd word one by one, with the same words."""

import json

import __spark_entry__ as entry
from foliant.sources import readers


def word(i, text="a", confidence=0.5):
    return [[[i, 1], [i + 3, 1.5], [i + 3, 9], [i, 9]], [text, confidence]]


def test_sound_and_odd_pages(spark):
    texts = ['x, "y"', "}},{", '{"p":', ',"w":{"t":', '","c":1}}', "é\\n[", "null", ""]
    sound = [word(i, x) for i, x in enumerate(texts)]
    odd = [[], "junk", None, [[[1, 2]]], [None, ["n", 1]], ["[[1, 2]]", ["str", 1]], [[[1, "x"]], ["p", 1]], [[], ["none", 1]], word(1, "q", "no"), word(1, "r", None), word(1, "s", "0.25"), 3]
    rows = [(0, json.dumps([sound])), *((i + 1, json.dumps([[*sound, x, word(7, "last")]])) for i, x in enumerate(odd)), (99, "[[]]")]
    got = {(r.id, r.pos): (r.text, r.bbox, r.confidence) for r in readers.result_tokens(spark.createDataFrame(rows, "id int, result string")).collect()}
    n = len(sound)
    for i in range(len(odd) + 1):
        assert [got[i, k] for k in range(n)] == [(x, [k, 1, k + 3, 9], 0.5) for k, x in enumerate(texts)]
        assert i == 0 or got[i, n + 1] == ("last", [7, 1, 10, 9], 0.5)
    assert {i: v for (i, k), v in got.items() if k == n and i} == {6: ("str", [1, 2, 1, 2], 1.0), 11: ("s", [1, 1, 4, 9], 0.25)}


def test_no_word_is_written_or_read_by_itself(spark, sf):
    """Writing lists takes one parse of a page at most for what is sound: no JSON is made for each word."""
    plan = entry.queries()["recognizer_results"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # Of lists and of objects once a page; a word's polygon and text had one more each.
    assert plan.lower().count("structstojson") == 2
