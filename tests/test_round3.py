"""Joins and stages that must not repeat work or gather rows in one task, and phrase matching without phrase rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from foliograph.operators import index, resolve
from foliograph.operators.grouping import left_join


def test_rows_without_a_key_are_dealt_evenly(spark):
    left = spark.range(2000).select(
        "id", F.lit("entities").alias("subdir"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k")
    )
    right = spark.createDataFrame([("entities", "k100", 1), ("entities", "k100", 2), ("entities", None, 3)], "subdir string, k string, v int")
    old = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in old}
    try:
        for k, v in old.items():
            spark.conf.set(k, v)
        joined = left_join(left, right, ["subdir", "k"])
        got = joined.select("id", "k", "v", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert joined.columns == ["subdir", "k", "id", "v"]
    assert len(got) == 2001 and sorted(r.v for r in got if r.v is not None) == [1, 2]
    none = [r.p for r in got if r.k is None]
    assert max(none.count(p) for p in set(none)) < len(none) / 2


def _similarities(df):
    """How often the executed plan computes the overlap of two descriptions."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("array_intersect")


def test_a_filter_on_the_outcome_computes_the_similarity_once(spark):
    text = "string"
    rows = spark.createDataFrame(
        [("a", 1, "entities", "Pump", "tool", "a pump for oil", "2001", "Pump", "Pump", "tool", "a pump for water", [], None, None, None)],
        f"source {text}, pos int, subdir {text}, name {text}, type {text}, description {text}, source_date {text}, safe {text}, p_name {text}, "
        f"p_type {text}, p_description {text}, p_dates array<string>, e_canonical_name {text}, canonical_safe {text}, canonical_exists boolean",
    )
    opened = resolve.early_stages(rows).filter(F.col("key").isNotNull()).select("source", "key")
    assert _similarities(opened) == 1
    assert opened.count() == 1


def test_resolve_hands_the_early_rows_to_a_cache_function(spark):
    items = spark.createDataFrame(
        [("s", 1, "entities", "Pump", "tool", "a pump for oil", "2001")],
        "source string, pos int, subdir string, name string, type string, description string, source_date string",
    )
    page = "---\ntype: entity\ntags: [tool]\n---\n\n# Pump\n\na pump for water\n"
    pages = spark.createDataFrame([("entities", "Pump", page)], "subdir string, name string, content string")
    entries = spark.createDataFrame(
        [], "canonical_name string, canonical_type string, compatible_types array<string>, description string, aliases array<string>, "
        "subdir string, tier string, reg_ord int",
    )
    done = resolve.resolve(items, pages, entries, lambda early: early.select("key", F.lit(True).alias("verdict")).filter("key IS NOT NULL"))
    assert [(r.action, r.stage, r.resolved_name) for r in done.collect()] == [("merge", 4, "Pump")]


def test_occurrences_of_words_and_phrases(spark):
    docs = spark.createDataFrame(
        [("a", "x y x y z", "", "", "y"), ("b", "", "", "", "")], "name string, content string, type string, tags string, extra string"
    )
    read = index.analysed(docs.withColumn("name", F.col("name")), ["name"])
    words = spark.createDataFrame([("x y",), ("y",), ("y x y",), ("z x",), ("",), ("x y x y",)], "word string")
    found = index.occurrences(read, ["name"], words, [1, 2, 3])
    got = sorted((r.name, r.word, r.n) for r in found.join(words, "word").groupBy("name", "word").agg(F.count("*").alias("n")).collect())
    assert got == [("a", "", 1), ("a", "x y", 2), ("a", "y", 2), ("a", "y x y", 1), ("b", "", 1)]
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_batches_for_python_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    texts = spark.range(300).select(F.repeat(F.lit("x"), 200_000).alias("text")).coalesce(1)
    got = texts.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 300
    assert max(r.size for r in got) < 8 << 20
