"""Removal against a brute-force scan, and the merge against sorting."""

import random

import numpy as np
import pytest

from foliograph.llm import substrings as ss
from foliograph.llm.common import F


def brute(docs, length):
    """{(id, text): runs} for distinct rows."""
    rows = sorted(set(docs), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[2]))
    seen, out = set(), {}
    for i, text, variant in rows:
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                hit[s:s + length] = b"\x01" * length
            seen.add(w)
        runs, s = [], None
        for p, h in enumerate([*hit, 0]):
            if h and s is None:
                s = p
            if not h and s is not None:
                runs.append((s, p))
                s = None
        out[i, text, variant] = runs
    return out


def test_merge_of_runs():
    rng = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        coded = []
        for run in runs:
            coded.append(ss.front_decode(*ss.front_code(run)) if run else iter(()))
        merged = list(ss.merge(coded))
        words = [w for _, w, _ in merged]
        assert words == sorted(w for run in runs for w in run)
        assert [c for _, _, c in merged][1:] == [ss.shared(a, b, 0) for a, b in zip(words[:-1], words[1:], strict=True)]


def corpus(seed, n, length):
    rng = random.Random(seed)
    words = ["alpha", "be", "çedille", "日本", "d", "\n", "  ", "eps"]
    base = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(120)) for _ in range(4)]
    texts = ["", None, "short", "a" * (3 * length), "ab" * length + "c" + "ab" * length]
    for _ in range(n):
        text = rng.choice(base)
        kind = rng.random()
        if kind < 0.2:
            texts.append(text)
        elif kind < 0.7:
            cuts = sorted(rng.sample(range(len(text)), 3))
            texts.append(text[:cuts[0]] + "#" + text[cuts[1]:cuts[2]] + text[cuts[0]:cuts[1]])
        else:
            a = rng.randint(0, len(text) - length - 5)
            texts.append("".join(rng.choice("xyzw ") for _ in range(80)) + text[a:a + length + rng.randint(-3, 3)] + "!")
    return texts


@pytest.mark.parametrize(("segment", "most"), [(1 << 21, 8192), (700, 4), (1 << 21, 0)])
def test_against_brute_force(spark, monkeypatch, segment, most):
    monkeypatch.setattr(ss, "SEGMENT", segment)
    texts = corpus(5, 40, 100)
    rows = [(i * 3 % 47, t, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ string")
    got = ss.dedup_substrings(docs, most=most).select("doc.doc_id", F.col("doc._").alias("place"), "n_bytes", "kept", "spans").collect()
    want = brute([(i, t, 0) for i, t, _ in rows], 100)
    by_id = {i: (t or "", want[i, t, 0]) for i, t, _ in rows}
    assert sum(len(r) for r in want.values()) > 20
    for r in got:
        text, runs = by_id[r.doc_id]
        assert [(s.start, s.end) for s in r.spans] == runs, r.doc_id
        raw, left, at = text.encode(), b"", 0
        for a, b in runs:
            left += raw[at:a]
            at = b
        assert bytes(r.kept) == left + raw[at:] and r.n_bytes == len(raw) and r.place == "own"


def test_repeated_ids_and_nulls(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(150)) + "end"
    rows = [(1, long), (1, long), (1, "other " + long), (None, long[:120]), (2, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, bytes(r.kept).decode()) for r in ss.dedup_substrings(docs).select("doc.doc_id", "kept").collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(spark, rows)))


def expected(spark, rows):
    hashed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", ss.F.xxhash64("text").alias("v")).collect()
    want = brute([(r.doc_id, r.text, r.v) for r in hashed], 100)
    for r in hashed:
        raw, left, at = r.text.encode(), b"", 0
        for a, b in want[r.doc_id, r.text, r.v]:
            left += raw[at:a]
            at = b
        yield r.doc_id, (left + raw[at:]).decode()


def test_marks_in_any_batches():
    """What is marked does not depend on where batches end."""
    rng = random.Random(8)
    rows = sorted((rng.randint(0, 9), rng.randint(0, 2), rng.randint(0, 5), 0, i) for i in range(60))
    names = ("gram", "around", "doc", "variant", "place")
    results = set()
    for size in (1, 2, 7, 60):
        batches = [ss.pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i:i + size]]) for i in range(0, 60, size)]
        results.add(tuple(sorted(map(str, (r for b in ss._marked(iter(batches)) for r in b.to_pylist())))))
    kinds = {}
    for g, a, *_ in rows:
        kinds.setdefault(g, set()).add(a)
    first = [r for i, r in enumerate(rows) if i == 0 or r[:2] != rows[i - 1][:2]]
    (only,) = results
    assert sum("'later': False" in r for r in only) == sum(len(kinds[r[0]]) > 1 for r in first)
    assert sum("'later': True" in r for r in only) == 60 - len(first)


def test_empty_table(spark):
    assert ss.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_string_has_an_anchor():
    raw = bytes(random.Random(2).choices(b"abcd ", k=5000))
    number, place, gram, _ = ss.text_anchors([raw], 100)
    starts = np.arange(len(raw) - 99)
    assert all(((place >= s) & (place + ss.GRAM <= s + 100)).any() for s in starts.tolist())
    assert len(place) < len(raw) / 25
