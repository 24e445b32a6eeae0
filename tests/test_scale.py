"""Plans that keep work in proportion to the input."""

import pytest
from pyspark.sql import functions as F

from foliograph.functions import pages as P
from foliograph.operators import lint, registry
from foliograph.operators import retrieval as R
from foliograph.plans import browse
from foliograph.session import grow_shuffles, spread, stored_bytes
from foliograph.sources import derived

DOCS = "subdir string, name string, type string, tags string, content string"


def _built(spark):
    """Pages whose text is put together row by row, as a derived wiki's is."""
    rows = [("entities", f"P{i}", i) for i in range(8)]
    front = F.concat(F.lit("---\ntype: entity\ntags: [tool, x]\nsources: [a, b, c]\nnote: "), F.sha2(F.col("i").cast("string"), 256))
    text = F.concat(front, F.lit("\n---\n\n# T\n\nA long enough paragraph about a tool of some kind.\n"))
    return spark.createDataFrame(rows, "subdir string, name string, i long").select("subdir", "name", text.alias("content"))


@pytest.mark.parametrize("plan, used", [
    (lambda p: lint.frontmatter_issues(p), 1),
    (lambda p: lint.thin_pages(p), 1),
    (lambda p: lint.bodyless_pages(p), 1),
    (lambda p: registry.promotable(p), 1),
    (lambda p: browse.filter_pages(browse.page_listing(p), "tool"), 1),
])
def test_page_text_is_built_once(spark, plan, used):
    found = plan(_built(spark))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == used
    found.collect()


def test_field_value_reads_only_lines_that_hold_the_key(rows):
    text = "---\ntype: a\nsubtype: b\nnote: type: c\n type : d: e\ntypes\n---\n"
    (got,), = rows([(text,)], "c string", v=P.field_value(F.col("c"), "type"))
    assert got == "d: e"


def test_scores_are_summed_where_a_document_lies(spark):
    docs = spark.createDataFrame([("entities", f"N{i}", "", "", "red ring " * (i % 3 + 1)) for i in range(30)], DOCS)
    queries = spark.createDataFrame([(1, "red"), (2, "ring red")], "query_id int, text string")
    plan = R.bm25(queries, docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(subdir" in plan and "hashpartitioning(query_id" not in plan


def test_best_of_alike_documents_are_the_best_of_all(spark):
    texts = ["red ring", "red", "blue ring ring", "ring red red bolt", "bolt"]
    rows = [(s, f"N{i % 23}", "", "", texts[i % 5]) for i in range(60) for s in ("entities", "concepts")]
    docs = spark.createDataFrame([*rows, *rows[:7], (None, None, None, None, "red")], DOCS)
    queries = spark.createDataFrame([(1, "red"), (2, "ring bolt"), (3, "red red ring"), (4, "none")], "query_id int, text string")
    order = ["query_id", "subdir", "name", "rank"]

    def cut(scores):
        return sorted(str((*[r[c] for c in order], round(r.score, 9))) for r in R.ranked(scores, 3).collect())

    assert cut(R.bm25(queries, docs, k=3)) == cut(R.bm25(queries, docs))


def test_tasks_follow_the_stored_size(spark, tmp_path):
    spark.range(40000).selectExpr("id", "sha2(string(id), 256) AS v").coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(stored).rdd.getNumPartitions() == cores
    assert spread(stored, 100_000).rdd.getNumPartitions() > 2 * cores
    assert spread(stored, 100_000).count() == 40000


def test_texts_are_read_once_for_scores_and_corpus_figures(spark):
    """Texts without a match, repeated ones and null ones count in the figures."""
    rows = [("entities", f"N{i}", "", "", text) for i, text in enumerate(["red ring", "blue bolt bolt", None, "red"])]
    docs = spark.createDataFrame([*rows, rows[0]], DOCS)
    queries = spark.createDataFrame([(1, "red"), (2, "none")], "query_id int, text string")
    found, stats = R.matching_documents(docs, R.query_terms(queries), ["subdir", "name"])
    assert {r.name: [tuple(m) for m in r.matched] for r in found.collect()} == {"N0": [(3, "red", 2.0)], "N3": [(2, "red", 1.0)]}
    assert (stats.n_docs, stats.avgdl) == (5, (3 + 4 + 1 + 2 + 3) / 5)
    none, stats = R.matching_documents(docs.limit(0), R.query_terms(queries), ["subdir", "name"])
    assert none.collect() == [] and not stats.n_docs


def test_shuffles_follow_the_stored_size(spark, tmp_path, monkeypatch):
    """Parts of an aggregate, which AQE does not split, are as many as the stored tables ask for, and never fewer than set."""
    key, parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(100_000).selectExpr("id AS n_nationkey", "sha2(string(id), 256) AS n_name", "id AS n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    monkeypatch.setattr(derived, "_GROWING", ("nation",))
    monkeypatch.setattr("foliograph.session.SHUFFLE_BYTES", 100_000)
    wanted = -(-stored_bytes(derived.table(spark, str(tmp_path), "nation")) // 100_000)
    try:
        rows = derived.relation(spark, str(tmp_path), "questions")
        assert wanted > 2 * parts and spark.conf.get(key) == str(wanted)
        plan = rows.groupBy("text").count()._jdf.queryExecution().executedPlan().toString()
        assert f", {wanted})" in plan
        grow_shuffles(spark, 1)
        assert spark.conf.get(key) == str(wanted)
    finally:
        spark.conf.unset(key)
