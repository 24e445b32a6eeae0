"""Fingerprints against sets of shingles in Python."""

import hashlib

import pytest

from foliograph.llm import fingerprints as fp
from foliograph.llm.common import F, table


def shingles(text):
    words = fp_words(text)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def fp_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def edited(text, following):
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def brute(rows):
    """(id, text) rows in order, with the next one's text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    return [(r[0], r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)]


@pytest.mark.parametrize("buckets", [1, 2, 7, 60])
def test_next_and_likeness(spark, buckets):
    base = " ".join(f"Word{i * i % 97}é" for i in range(60))
    rows = [(i, base[i:] + f" end{i}" if i % 3 else f"w{i} " * i) for i in range(40)]
    rows += [(7, "twin"), (7, "twin"), (7, None), (None, "no id"), (None, None), (-5, ""), (10**15, "ab cd")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string")
    pairs = fp.edited_pairs(docs, share=1.0, buckets=buckets)
    got = pairs.select(
        "doc.doc_id", "doc.bucket", "n_chars", "edited", fp.likeness(F.col("sketch"), F.col("edited_sketch"), 1.0).alias("a"),
        fp.likeness(F.col("sketch"), F.col("next_sketch"), 1.0).alias("b"),
        fp.containment(F.col("sketch"), F.col("edited_sketch"), 1.0).alias("c"),
    ).collect()
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for i, text, following in brute(rows):
        one, other, third = shingles(text), shingles(edited(text, following)), shingles(following)
        want.append((str(i), len(text), edited(text, following), jaccard(one, other), jaccard(one, third), len(one & other) / len(one) if one else 1.0))
    assert sorted((str(r.doc_id), r.n_chars, r.edited, r.a, r.b, r.c) for r in got) == sorted(want)


def test_estimates_are_near(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = fp.edited_pairs(docs).select("doc.doc_id", "edited", fp.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    errors = []
    for r in rows:
        a, b = shingles(texts[r.doc_id]), shingles(r.edited)
        errors.append(abs(r.near - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert sum(errors) / len(errors) < 0.06 and max(errors) < 0.35


def test_merged_is_the_sketch_of_the_union(spark):
    long, short = " ".join(f"a{i}" for i in range(3000)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "k", long), (2, "k", short), (3, "s", short), (4, "s", short + " c d e f g"), (5, "e", "")],
                                 "doc_id long, k string, text string")
    sketches = fp.fingerprints(docs).select("doc.k", "sketch")
    got = {}
    for r in fp.merged(sketches, "k").collect():
        got.setdefault(r.k, set()).add(r.hash)
    for key, texts in (("k", [long, short]), ("s", [short, short + " c d e f g"])):
        hashes = set()
        for t in spark.createDataFrame([(t,) for t in texts], "text string").select(fp.shingle_hashes(fp.space_words(F.col("text"))).alias("h")).collect():
            hashes |= set(t.h)
        below = {h for h in hashes if h < fp._bound(fp.SHARE)}
        assert got[key] == (below if len(below) >= fp.LEAST else set(sorted(hashes)[:fp.LEAST]))
    assert "e" not in got


def test_query_is_native_and_whole(spark):
    result = fp.query(spark, "/root/testdata/sf0.001")
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = {r.doc_id: r for r in result.collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    for i, text, following in brute([(r.doc_id, r.text) for r in docs]):
        assert rows[i].edited_sha256 == hashlib.sha256(edited(text, following).encode()).hexdigest()
    by_text = {}
    for r in docs:
        assert by_text.setdefault(r.text, rows[r.doc_id].fingerprint) == rows[r.doc_id].fingerprint


def test_empty_table(spark):
    assert fp.edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
