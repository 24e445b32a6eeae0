"""Index relations: analysed documents, postings, document statistics and the raw-file index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import pages as P
from foliograph.functions.porter import stems
from foliograph.operators.grouping import last_row

FIELDS = ("name", "type", "tags", "content")


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def searchable(pages: DataFrame, *keep: Column) -> DataFrame:
    """The four indexed fields of every page, one row per page file (outer blanks hold no tokens); ``keep`` are more columns."""
    return pages.select(
        "subdir",
        "name",
        *keep,
        P.searched_type(F.col("content")).alias("type"),
        P.searched_tags(F.col("content")).alias("tags"),
        P.raw_body(F.col("content")).alias("content"),
    )


def restemmed(terms: DataFrame) -> DataFrame:
    """(term, stem_term) of the distinct terms of a relation: every word of a term by its stem."""
    each = terms.select("term").distinct().select("term", F.posexplode(F.split("term", " ")).alias("i", "word"))
    parts = F.sort_array(F.collect_list(F.struct("i", "stem")))
    joined = each.join(stems(each), "word").groupBy("term").agg(parts.alias("parts"))
    return joined.select("term", F.array_join(F.transform("parts", lambda p: p["stem"]), " ").alias("stem_term"))


def analysed(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token arrays per field plus the document length; one narrow pass over the text."""
    tokens = plain_tokens
    out = docs.select(*keys, *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t_{f}") for f in FIELDS])
    return out.withColumn("dl", sum((F.size(f"t_{f}") for f in FIELDS), F.lit(0)))


def grams(tokens: Column, n: int) -> Column:
    """Adjacent n-token phrases; the positions too close to the end give NULL."""
    phrase = tokens
    for offset in range(2, n + 1):
        shifted = F.slice(tokens, offset, F.greatest(F.size(tokens), F.lit(1)))
        phrase = F.zip_with(phrase, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return phrase


def term_rows(docs: DataFrame, keys: Sequence[str], phrase_lengths: Sequence[int] = (1,)) -> DataFrame:
    """(keys, dl, term, weight): one row per token or phrase occurrence."""
    fields = F.array(
        *[
            F.struct(F.lit(K.BM25_WEIGHTS[f]).alias("weight"), grams(F.col(f"t_{f}"), n).alias("terms"))
            for f in FIELDS
            for n in phrase_lengths
        ]
    )
    per_field = docs.select(*keys, "dl", F.inline(fields))
    rows = per_field.select(*keys, "dl", "weight", F.explode("terms").alias("term"))
    return rows.filter(F.col("term").isNotNull()) if max(phrase_lengths) > 1 else rows


def occurrences(docs: DataFrame, keys: Sequence[str], words: DataFrame, phrase_lengths: Sequence[int] = (1,)) -> DataFrame:
    """(keys, dl, word, weight): one row per occurrence of the distinct words and phrases of a relation, and one of the empty
    word per text. A phrase is put together only where its first word stands, so other tokens are not copied."""
    n = F.size(F.split("word", " "))
    heads = words.select(F.substring_index("word", " ", 1).alias("first"), n.alias("n")).filter(F.col("n").isin(*phrase_lengths)).distinct()
    mark = F.struct(F.lit(1.0).alias("weight"), F.array(F.lit("")).alias("tokens"))
    fields = F.array(mark, *[F.struct(F.lit(K.BM25_WEIGHTS[f]).alias("weight"), F.col(f"t_{f}").alias("tokens")) for f in FIELDS])
    each = docs.select(*keys, "dl", F.inline(fields)).select(*keys, "dl", "weight", "tokens", F.posexplode("tokens").alias("at", "first"))
    longest = F.slice("tokens", F.col("at") + 1, F.lit(max(phrase_lengths)))
    found = each.select(*keys, "dl", "weight", "first", longest.alias("ahead")).join(heads, "first")
    found = found.filter(F.size("ahead") >= F.col("n"))  # fewer words are left at the end of a field
    word = F.when(F.col("n") == 1, F.col("first")).otherwise(F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " "))
    return found.select(*keys, "dl", word.alias("word"), "weight")


def postings(docs: DataFrame, keys: Sequence[str], phrase_lengths: Sequence[int] = (1,)) -> DataFrame:
    """(keys, dl, term, f): weighted term frequency over the four fields."""
    rows = term_rows(docs, keys, phrase_lengths)
    return rows.groupBy(*keys, "dl", "term").agg(F.sum("weight").alias("f"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and average length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def raw_file_index(pages: DataFrame) -> DataFrame:
    """(filename, source_page, source_hash) from the markers of source pages; the last page wins."""
    rows = pages.filter(F.col("subdir") == "sources").select(
        F.explode(P.source_markers(F.col("content"))).alias("filename"),
        F.col("name").alias("source_page"),
        P.source_hash(F.col("content")).alias("source_hash"),
    )
    return last_row(rows, ["filename"], F.struct("source_page", "source_hash"))
