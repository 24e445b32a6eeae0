"""Components against all pairs in Python."""

import random

import pytest

from foliograph.llm import jaccard
from foliograph.llm.common import table
from tests.llm.test_fingerprints import shingles


def brute(rows):
    """Sorted (id, set size, component)."""
    nodes = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_size = sorted((n for n in nodes if n[0] is not None and n[1]), key=lambda n: len(n[1]))
    for x, (i, a) in enumerate(by_size):
        for j, b in by_size[x + 1:]:
            if 80 * len(b) > 100 * len(a):
                break
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((str(i), len(s), str(root(i) if i is not None else None)) for i, s in nodes)


def found(docs):
    rows, _ = jaccard.join_components(docs)
    return sorted((str(r.doc), r.n, str(r.component)) for r in rows.collect())


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies(spark, seed):
    rng = random.Random(seed)
    rows = []
    for group in range(4):
        n = rng.choice([20, 90, 300])
        words = [f"g{group}w{rng.randint(0, 99)}" for _ in range(n)]
        for _ in range(25):  # a drift: neighbours link, ends do not
            words = words.copy()
            for _ in range(max(1, n // 60)):
                words[rng.randrange(n)] = f"new{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    rows += [(2000, "one two"), (2001, "One  two"), (2002, ""), (2003, None), (2004, " \n"), (None, "one two"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, doc string")
    assert found(docs) == brute(rows)


def test_sizes_at_the_edge_of_a_link(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k))) for k in range(5, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_repeated_ids_are_one_document(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = spark.createDataFrame([(5, a), (5, b), (5, b), (3, a), (9, b), (1, "x y z a b c")], "doc_id long, text string")
    assert {(r.doc, r.component) for r in jaccard.join_components(docs)[0].collect()} == {(5, 3), (3, 3), (9, 3), (1, 1)}


def test_links_of_classes(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " more"), (4, "other words than those of all others")], "doc_id long, text string")
    _, links = jaccard.join_components(docs)
    assert [tuple(r) for r in links.collect()] == [(1, 3)]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_tiles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(60)]
    rows = [(k, " ".join(shared + [f"own{k}x{i}" for i in range(12 + rng.randint(0, 3))])) for k in range(40)]
    rows += [(k + 100, t + " tail") for k, t in rows[::4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_all_links(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(60):  # nearly all pairs link, and stars see few of them
        words = base.copy()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(150)] = f"new{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, "  ".join(t.split())) for k, t in rows[:9]] + [(300, "alone " * 9), (301, ""), (None, rows[0][1])]
    rows += [(400, rows[3][1]), (400, " ".join(f"x{i}" for i in range(40))), (401, " ".join(f"x{i}" for i in range(41)))]
    sets = [(i, shingles(t)) for i, t in rows]
    same = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    want = sorted((str(i), len(a), sum(bool(same(a, b)) for y, (j, b) in enumerate(sets) if x != y and None not in (i, j))) for x, (i, a) in enumerate(sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    least = {}
    for i, a in sets:
        if a and i is not None:
            least[frozenset(a)] = min(i, least.get(frozenset(a), i))
    different = sorted((min(p, q), max(p, q)) for x, (a, p) in enumerate(least.items()) for b, q in list(least.items())[:x] if same(a, b))
    for block in (2048, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert sorted((str(r.doc), r.n, r.links) for r in jaccard.join_counts(docs).collect()) == want
        assert sorted(tuple(r) for r in jaccard.join_components(docs)[1].collect()) == different


def test_words_may_hold_any_separator(spark):
    """One word with a control character inside is not two words."""
    docs = spark.createDataFrame([(1, "a\x1fb"), (2, "a b"), (3, "a\x1fb "), (4, "a\x00b")], "doc_id long, text string")
    rows, _ = jaccard.join_components(docs)
    assert sorted((r.doc, r.component) for r in rows.collect()) == [(1, 1), (2, 2), (3, 1), (4, 4)]
