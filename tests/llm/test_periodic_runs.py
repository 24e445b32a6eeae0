"""Runs against brute force over all periods and starts."""

import binascii
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliograph.llm import periodic_runs as pr


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[p:], strict=False)))


def brute(words, least=12):
    """All runs by definition: maximal stretches of each period, kept if it is their smallest."""
    found = []
    for p in range(1, len(words) // 2 + 1):
        s = 0
        while s + p < len(words):
            e = s
            while e + p < len(words) and words[e] == words[e + p]:
                e += 1
            if e + p - s >= max(least, 2 * p) and smallest_period(words[s:e + p]) == p:
                found.append((s, e + p - s, p))
            s = max(e, s) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(texts, least=12):
    for text, (n, rows, kept) in zip(texts, pr.runs_of(texts, least), strict=True):
        words = re.findall(r"[^ \t-\r]+", text)
        want = brute(words, least)
        assert n == len(words)
        assert [tuple(r) for r in rows.tolist()] == want, text
        assert kept == collapsed(words, want)


def test_cover():
    assert {(a - b) % pr.MODULUS for a in pr.COVER for b in pr.COVER} == set(range(pr.MODULUS))


@pytest.mark.parametrize("seed", range(6))
def test_extensions(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 200))
    seq = rng.integers(0, rng.integers(1, 4), n)
    seq = np.concatenate([seq, seq[: n // 2], [9]])
    e = pr.Extensions(seq)
    x, y = (g.ravel() for g in np.meshgrid(np.arange(len(seq)), np.arange(len(seq))))
    x, y = x[x != y], y[x != y]
    want = [next(d for d in range(len(seq)) if max(a, b) + d == len(seq) or seq[a + d] != seq[b + d]) for a, b in zip(x, y, strict=True)]
    assert e.of(x, y).tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60).map(" ".join), max_size=4), st.sampled_from([2, 3, 12]))
def test_two_words(texts, least):
    check(texts, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_planted(parts):
    check([" ".join("".join(cycle * times for cycle, times in parts)), "", " \n"])


def test_long_and_nested():
    rng = random.Random(2)
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    check([" ".join(fib[-1]), "x " * 1500, " ".join(rng.choice("ab") for _ in range(1200)), "a b\x1fc\x0b d\te " * 30])


def test_pairs_in_pieces(monkeypatch):
    monkeypatch.setattr(pr, "PAIRS", 7)
    check(["a b a b a b a b a b a b a b " * 5, "c " * 40 + "d " * 40])


def test_very_long_text():
    text = "start " + "one two three " * 300_000 + "end"
    ((n, rows, kept),) = pr.runs_of([text])
    assert (n, rows.tolist(), kept) == (900_002, [[1, 900_000, 3]], "start one two three end")


def test_documents(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90))) for _ in range(120)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(500, None, None), (501, "", "x"), (502, " \t\n", "x"), (None, "z " * 30, "x"), (3, texts[3], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnsRenamed({"runs": "filled"})
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def want(doc_id, text):
        words = re.findall(r"[^ \t-\r]+", text or "")
        h = binascii.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return (
            doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)), n,
        )

    got = [tuple(r) for r in pr.query(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(want(i, t)) for i, t, _ in rows)
    assert sum(r[1] > 0 for r in got) > 8
    odd = pr.detect_runs(docs.withColumnsRenamed({"doc_id": "doc", "filled": "_"})).select("doc.doc", "doc._", "n_words").collect()
    assert sorted(map(str, odd)) == sorted(str(type(odd[0])(doc=i, _=x, n_words=len((t or "").split()))) for i, t, x in rows)


def test_empty_and_only_text(spark):
    docs = spark.createDataFrame([], "text string")
    assert pr.detect_runs(docs).collect() == []
    only = spark.createDataFrame([("a " * 12,)], "text string")
    assert [(r.doc, r.n_words, [tuple(x) for x in r.runs]) for r in pr.detect_runs(only).collect()] == [(None, 12, [(0, 12, 1)])]
