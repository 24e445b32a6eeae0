"""Index and phrase search against string search in Python."""

import random
import re

from foliograph.llm import decontaminate as dc
from foliograph.llm.common import F


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window):
    out = []
    for i, text in docs:
        have, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            n = min(window, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for p in range(len(have) - n + 1):
                    if have[p:p + n] == w[s:s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out.append((str(i), len(have), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(have)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "and", "Ça", "b1", "zeta", "rare", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 6, 9])))) for i in range(12)]
    items += [(3, "another of three"), (20, None), (21, " .,"), (22, items[0][1]), (None, "rare rare rare rare")]
    docs = [(i, "-".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 80])))) for i in range(25)]
    docs += [(0, docs[3][1]), (0, docs[3][1]), (None, "an another OF Three!"), (99, None), (98, "x" * 400), (97, items[2][1]), (96, "y z " * 300 + items[1][1])]
    d = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 9):
        got = dc.decontaminate(d, b, window=4, block=block).select("doc.doc_id", "doc.words", "n_words", "n_hit", "items", "contaminated").collect()
        assert {r.words for r in got} == {"own"}
        want = brute(docs, [(i, t) for i, t in items if i is not None], 4)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == brute_with_null(docs, items, want)


def brute_with_null(docs, items, want):
    """An item without an id hits words, but has no id to list."""
    everything = brute(docs, items, 4)
    return sorted((i, n, h, [x for x in found if x != "None"], c) for i, n, h, found, c in everything)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two gap three four five"), (2, "one two and much later three four five")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    texts, _ = dc.test_texts(bench, "item_id", "text")
    rows = dc.keyed(docs, "doc_id", "text")
    terms = texts.select(F.explode("words").alias("term")).distinct()
    chosen = dc.anchors(texts, dc.term_counts(rows, terms), 2)
    places = dc.alignments(dc.postings(rows, terms), chosen)
    near = {r.doc: r.share for r in dc.proximity_hits(rows, places, texts, 1, 0.9).collect()}
    assert near == {1: 1.0}


def test_near_items(spark):
    item = "the cat of my aunt sat under a small red table today"
    texts = [
        item.replace("cat of", "cat oddly of"), item.replace("aunt", "uncle"), item.replace("red", "unheardof"), f"then {item} too",
        "the cat and my aunt never met", "today table red small a under sat", None, "uncle oddly",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item.replace("small", "absentword")), (3, "absentword"), (4, None)], "item_id long, text string")
    for block in (500_000, 5):
        got = {r.doc_id: r.near for r in dc.near_items(docs, bench, block=block).select("doc.doc_id", "near").collect()}
        assert got == {i: ["1", "2"] if i < 4 else [] for i in range(len(texts))}
    assert dc.near_items(docs.limit(0), bench).count() == 0
    assert {len(r.near) for r in dc.near_items(docs, bench.limit(0)).collect()} == {0}
    plan = dc.near_query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert dc.decontaminate(empty, bench).count() == 0
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dc.decontaminate(docs, bench.limit(0)).collect()] == [(2, 0)]


def test_query_is_native(spark):
    plan = dc.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
