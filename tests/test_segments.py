"""The segmented index against the direct plan, through updates, deletions and merges."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators import index as I
from foliograph.operators import retrieval as R
from foliograph.operators import segments as S

SCHEMA = "subdir string, name string, content string"
WORDS = ["graph", "graphs", "running", "cache", "kv", "relational", "model", "models", "note", "the", "index"]


def page(rng, i, n):
    subdir = rng.choice(["sources", "entities", "concepts"])
    body = " ".join(rng.choices(WORDS, weights=range(1, 12), k=rng.randint(0, 25)))
    links = " ".join(f"[[{rng.choice(['p', 'P'])}{rng.randrange(n)}]]" for _ in range(rng.randint(0, 3)))
    return (subdir, f"P{i}", f"---\ntype: {rng.choice(WORDS)}\ntags: [kv, {rng.choice(WORDS)}]\n---\n{body} {links}")


QUESTIONS = [(1, "graph models"), (2, "kv_cache kv_cache running note"), (3, "the relational index"), (4, "absent"), (5, "the_the note"), (6, "kv"), (7, "cache_kv_graph the")]


def same(spark, got, pages, k, expand, stemmed):
    qs = spark.createDataFrame(QUESTIONS, "query_id int, text string")
    want = R.search(qs, pages, k, expand, stemmed, R.phrase_lengths(qs))
    key = lambda d: sorted((r.query_id, r.name, r["rank"], round(r.score, 7)) for r in d.collect())
    assert key(got) == key(want)
    return key(got)


def test_updates_deletions_and_merges(spark, tmp_path):
    stemmed = False
    rng = random.Random(11)
    live, n = {}, 120
    index = S.SegmentIndex(spark, str(tmp_path), stemmed, slice_pages=7)
    assert S.top_pages(spark.createDataFrame(QUESTIONS, "query_id int, text string"), index, 5).count() == 0
    sizes = []
    for step in range(5):
        changed = [page(rng, i, n) for i in (range(n) if step == 0 else rng.sample(range(n + 10), 6))]
        changed = list({p[:2]: p for p in changed}.values())
        gone = [key for key in sorted(live) if rng.random() < 0.06 and key not in {p[:2] for p in changed}]
        index.commit(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame(gone, "subdir string, name string"))
        for key in gone:
            del live[key]
        live.update({p[:2]: p for p in changed})
        sizes.append(len(index.segments))
    assert sizes == [1, 2, 3, 4, 2]  # the small ones were merged, the large one stayed
    pages = spark.createDataFrame(list(live.values()), SCHEMA)
    again = S.SegmentIndex(spark, str(tmp_path), stemmed, slice_pages=7)
    qs = spark.createDataFrame(QUESTIONS, "query_id int, text string")
    assert again.stats().n_docs == len(live)
    assert len(same(spark, S.search(qs, again, 4), pages, 4, True, stemmed)) > 15
    same(spark, S.search(qs, again, 6, expand=False), pages, 6, False, stemmed)
    again.sync(pages)
    assert again.version == index.version  # nothing had changed
    tokens = I.analysed(I.searchable(pages), list(S.KEY))
    direct = I.postings(tokens, list(S.KEY)).select(*S.KEY, "dl", "term", "f")
    stored = again.postings().select(*S.KEY, "dl", "term", "f")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))


def test_bounds_leave_blocks_out(spark, tmp_path):
    """Rare words reach scores that the blocks of a frequent word can not."""
    rng = random.Random(3)
    rows = [("entities", f"P{i}", "common " * rng.randint(1, 3) + " ".join(f"w{rng.randrange(300)}" for _ in range(30))) for i in range(400)]
    rows += [("entities", f"R{i}", "rare rare common") for i in range(6)]
    pages = spark.createDataFrame(rows, SCHEMA)
    index = S.SegmentIndex(spark, str(tmp_path), False, slice_pages=20)
    index.commit(pages)
    qs = spark.createDataFrame([(1, "rare common")], "query_id int, text string")
    bounded, phrases, average = S.bounds(index, qs, R.query_terms(qs))
    chosen = S.useful_blocks(index, bounded, phrases, average, 5)
    total, read = (d.agg(F.sum("n")).first()[0] for d in (bounded, chosen))
    assert total == 412 and read < total / 4
    whole, cut = (S.top_pages(qs, index, 5, prune).select("name", "rank", F.round("score", 9)).collect() for prune in (False, True))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(cut) == 5
    plan = index.blocks(spark.createDataFrame([("rare",)], "term string")).drop("postings")._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_another_analyser_is_an_error(spark, tmp_path):
    S.SegmentIndex(spark, str(tmp_path), True).commit(spark.createDataFrame([("entities", "A", "text")], SCHEMA))
    with pytest.raises(ValueError, match="analyser"):
        S.SegmentIndex(spark, str(tmp_path), False)


def test_stems_and_sync(spark, tmp_path):
    rng = random.Random(12)
    index = S.SegmentIndex(spark, str(tmp_path))
    pages = None
    for version in (1, 2):
        pages = spark.createDataFrame([page(rng, i, 40) for i in rng.sample(range(60), 40)], SCHEMA).dropDuplicates(["subdir", "name"]).persist()
        index.sync(pages, version)
    index.sync(pages.filter("name < 'A'"), 2)  # synced with that version already
    qs = spark.createDataFrame(QUESTIONS, "query_id int, text string")
    assert index.version == 2 and index.docs().count() == pages.count()
    assert len(same(spark, S.search(qs, index, 4), pages, 4, True, True)) > 15


def test_deleting_all_pages(spark, tmp_path):
    index = S.SegmentIndex(spark, str(tmp_path), False)
    one = spark.createDataFrame([("entities", "A", "some text")], SCHEMA)
    index.commit(one)
    index.commit(deleted=one)
    asked = spark.createDataFrame([(1, "text")], "query_id int, text string")
    assert index.stats().n_docs == 0 and S.search(asked, index).collect() == []
    index.commit(one)
    assert [r.name for r in S.search(asked, index).collect()] == ["A"]


def test_a_frequent_term_is_many_stored_rows(spark, tmp_path):
    """Postings of a block are rows of their own, so that a reader's batch holds few of them."""
    index = S.SegmentIndex(spark, str(tmp_path), False)
    index.commit(spark.createDataFrame([("entities", f"P{i}", "common") for i in range(300)], SCHEMA))
    term = spark.createDataFrame([("common",)], "term string")
    assert index.entries(term).count() == 300
    assert [r.n for r in index.blocks(term).collect()] == [300]


def test_a_commit_counts_the_words_of_a_page_inside_its_row(spark, tmp_path):
    """Neither the words of pages nor their postings are grouped by page across tasks."""
    rows = [("entities", "Twice", "---\ntype: kv\ntags: [kv, note]\n---\nkv note kv"), ("entities", "Empty", "")]
    tokens = I.analysed(I.searchable(spark.createDataFrame(rows, SCHEMA)), list(S.KEY))
    entries = S.page_entries(tokens)
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString()
    got = {r.name: [(p.term, p.f, [x >> 32 for x in p.positions]) for p in r.postings] for r in entries.collect()}
    assert got == {"Twice": [("kv", 10.0, [1, 2, 3, 3]), ("note", 6.0, [2, 3]), ("twice", 10.0, [0])], "Empty": [("empty", 10.0, [0])]}
    index = S.SegmentIndex(spark, str(tmp_path), False, slice_pages=2)
    many = [("entities", f"P{i}", f"common word{i}") for i in range(40)]
    index.commit(spark.createDataFrame(many, SCHEMA))
    index.commit(spark.createDataFrame(many[:1], SCHEMA))
    assert index.postings().filter("term = 'common'").count() == 40
    # Only the segment with a dead row meets the dead rows.
    plan = index.postings()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("LeftAnti") == 1


@pytest.mark.parametrize("stemmed", [False, True])
def test_pages_of_one_key_and_without_a_name(spark, tmp_path, stemmed):
    """Pages of one key and length are one in the postings; a page without a name has postings but is no document."""
    rows = [("entities", "A", "kv graph"), ("entities", "A", "kv model"), ("entities", None, "kv"), ("entities", "B", "kv")]
    index = S.SegmentIndex(spark, str(tmp_path), stemmed)
    index.commit(spark.createDataFrame(rows, SCHEMA))
    got = {(r.name, r.term): (r.f, len(r.positions)) for r in index.postings().filter("term = 'kv'").collect()}
    assert got == {("A", "kv"): (2.0, 2), (None, "kv"): (1.0, 1), ("B", "kv"): (1.0, 1)}
    assert sorted(r.name for r in index.docs().collect()) == ["A"] * 4 + ["B"]


def test_frequent_terms_are_scored_only_on_pages_that_others_found(spark, tmp_path):
    """Pages that hold only a frequent word cannot be among the best, and get no score; the others get their whole one."""
    rows = [("entities", f"P{i}", "common " * (i % 5 + 1) + f"w{i}") for i in range(300)]
    rows += [("entities", f"R{i}", "rare common " + "word " * i) for i in range(8)]
    index = S.SegmentIndex(spark, str(tmp_path), False, slice_pages=20)
    index.commit(spark.createDataFrame(rows, SCHEMA))
    qs = spark.createDataFrame([(1, "rare common")], "query_id int, text string")
    bounded, phrases, average = S.bounds(index, qs, R.query_terms(qs))
    reached = S.reached_scores(index, bounded, phrases, average, 5)
    chosen = S.useful_blocks(index, bounded, phrases, average, 5, reached)
    scored = S.best_scores(index, chosen, phrases, reached, average, 5).select("name").collect()
    assert 5 <= len(scored) <= 8 and all(r.name.startswith("R") for r in scored)
    whole, cut = (S.top_pages(qs, index, 5, prune).select("name", "rank", F.round("score", 9)).collect() for prune in (False, True))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(cut) == 5
