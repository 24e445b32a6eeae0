"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import bpe
from foliograph.llm.common import stored, table
from foliograph.llm.decontaminate import decontaminate
from foliograph.llm.jaccard import join_components
from foliograph.llm.line_dedup import dedup_lines
from foliograph.llm.quality import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from all labels. Null and empty texts are judged like
    others, by their host and path."""
    return kept(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go; n_chars is counted anew. Null and empty texts are one empty line, which stays (as an
    empty text)."""
    kept = dedup_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return kept.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id. Documents without an id, or without
    words, are in no group; rows that repeat an id are documents of their own (of equal ones in a group
    one stays)."""
    given = docs.filter("doc_id IS NOT NULL")
    if not _repeats(given):
        rows, _ = join_components(given.select("doc_id", "text"))
        gone = stored(rows.filter("doc <> component").select(F.col("doc").alias("doc_id")), "near-duplicates")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Rows get numbers, which are written so that they do not change.
    number = next(n for n in ("row", *(f"row{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows, _ = join_components(numbered.filter("doc_id IS NOT NULL").select(number, "text"), number)
    named = rows.filter("n > 0").join(numbered.select(F.col(number).alias("doc"), "doc_id"), "doc")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "doc")).alias("first"))
    gone = named.join(first, "component").filter(F.col("doc") != F.col("first.doc")).select(F.col("doc").alias(number))
    return numbered.join(stored(gone, "near-duplicates"), number, "left_anti").select(*docs.columns)


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; those without words stay."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("contaminated")).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, of every row; a null text is an empty one."""
    return bpe.digests(docs)


STAGES = [
    ("quality", quality), ("line dedup", line_dedup), ("near duplicates", near_duplicates),
    ("decontamination", decontamination), ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for position, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
