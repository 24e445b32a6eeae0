"""Retrieval against an independent full-text engine and against brute force."""

import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliograph.operators import index
from foliograph.operators import retrieval as R

WORDS = ["graph", "graphs", "running", "runner", "cache", "kv", "müller", "Muller", "relational", "model", "models", "the", "note"]


def _docs(seed, n):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    return [("entities", f"page{i:03d} {text(1)}", rng.choice(["tool", "model"]), text(2), text(rng.randint(0, 30)) + rng.choice(["", " kv cache"])) for i in range(n)]


def _reference(docs, query, stemmed):
    tokenizer = "porter unicode61" if stemmed else "unicode61 remove_diacritics 0"
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE f USING fts5(name, type, tags, content, tokenize='{tokenizer}')")
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", [d[1:] for d in docs])
    found = con.execute("SELECT name, -bm25(f, 10.0, 3.0, 5.0, 1.0) FROM f WHERE f MATCH ?", (query,)).fetchall()
    return {name: score for name, score in found}


@pytest.mark.parametrize("stemmed", [False, True])
def test_bm25_equals_independent_engine(spark, stemmed):
    docs = _docs(1, 60)
    queries = [(1, "graph models"), (2, "kv_cache kv_cache runner"), (3, "Müller the relational"), (4, "absent"), (5, "note")]
    df = spark.createDataFrame(docs, "subdir string, name string, type string, tags string, content string")
    qs = spark.createDataFrame(queries, "query_id int, text string")
    got = {}
    for r in R.bm25(qs, df, stemmed=stemmed, lengths=R.phrase_lengths(qs)).collect():
        got.setdefault(r.query_id, {})[r.name] = r.score
    for query_id, text in queries:
        want = _reference(docs, " OR ".join(text.lower().split()), stemmed)
        assert set(got.get(query_id, {})) == set(want)
        for name, score in want.items():
            assert got[query_id][name] == pytest.approx(score, abs=1e-9)


def test_expansion_ranks_are_exact_for_a_hub(spark):
    """A hub's neighbours: the best k and every text-matched one get their true rank."""
    rng = random.Random(2)
    near = [(1, f"n{i:04d}", rng.choice([1, 1, 1, 2, 3])) for i in range(3000)]
    listed = [(1, f"n{i:04d}") for i in range(5, 3000, 97)] + [(1, "elsewhere")]
    hits = spark.createDataFrame(near, "query_id int, name string, hits long")
    got = {r.name: r["rank"] for r in R.expansion_ranks(hits, spark.createDataFrame(listed, "query_id int, name string"), 20).collect()}
    order = [n for _, n, _ in sorted(near, key=lambda r: (-r[2], r[1]))]
    want = {n: i for i, n in enumerate(order, 1)}
    expected = set(order[:20]) | {n for _, n in listed if n in want}
    assert got == {n: want[n] for n in expected}


def test_duplicate_seeds_count_twice(spark):
    pages = spark.createDataFrame([("entities", "A", "[[B]]"), ("entities", "B", ""), ("entities", "C", "[[B]]")], "subdir string, name string, content string")
    seeds = spark.createDataFrame([(1, "A"), (1, "A"), (1, "C")], "query_id int, name string")
    got = [tuple(r) for r in R.expansion_hits(seeds, pages).collect()]
    assert got == [(1, "B", 3)]


def test_budget_equals_greedy_loop(spark):
    rng = random.Random(4)
    pages, found = [], []
    for q in range(40):
        for rank in range(1, 9):
            name = f"q{q}r{rank}"
            pages.append((rng.choice(["sources", "entities"]), name, "x" * rng.randint(0, 60)))
            found.append((q, name, 1.0 / rank, rank))
    got = {}
    ctx = R.context(spark.createDataFrame(found, "query_id int, name string, score double, rank int"), spark.createDataFrame(pages, "subdir string, name string, content string"), 100)
    for r in ctx.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.name)
    by_name = {n: (s, len(c)) for s, n, c in pages}
    for q in range(40):
        names = [n for qq, n, _, _ in found if qq == q]
        total, want = 0, []
        for n in [n for n in names if by_name[n][0] == "sources"] + [n for n in names if by_name[n][0] != "sources"]:
            if want and total + by_name[n][1] > 100:
                break
            want.append(n)
            total += by_name[n][1]
        assert got[q] == want


def test_search_without_hits_is_empty(spark):
    pages = spark.createDataFrame([("entities", "A", "alpha")], "subdir string, name string, content string")
    assert R.search(spark.createDataFrame([(1, "zzz"), (2, "!!!")], "query_id int, text string"), pages).count() == 0


def test_postings_count_every_token(spark):
    docs = spark.createDataFrame([("entities", "A b", "b", "b", "b b c")], "subdir string, name string, type string, tags string, content string")
    got = {r.term: r.f for r in index.postings(index.analysed(docs, ["subdir", "name"]), ["subdir", "name"]).collect()}
    assert got == {"a": 10.0, "b": 10.0 + 3.0 + 5.0 + 2.0, "c": 1.0}
    assert Counter(got)["zz"] == 0
    assert docs.select(F.size(index.grams(F.split("content", " "), 2)).alias("n")).first().n == 3


def test_a_phrase_is_not_found_past_the_end_of_a_field(spark):
    """The first word of a phrase at the end of a text is no phrase, and does not count once more as that word."""
    docs = [("entities", "A", "tool", "x", "note kv"), ("entities", "B", "tool", "x", "kv note"), ("entities", "C", "tool", "x", "kv cache")]
    df = spark.createDataFrame(docs, "subdir string, name string, type string, tags string, content string")
    words = spark.createDataFrame([("kv",), ("kv cache",)], "word string")
    found = index.occurrences(index.analysed(df, ["name"]), ["name"], words, [1, 2])
    got = sorted((r.name, r.word) for r in found.filter("word <> ''").collect())
    assert got == [("A", "kv"), ("B", "kv"), ("B", "kv note"), ("C", "kv"), ("C", "kv cache")]
