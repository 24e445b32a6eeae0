"""Line dedup: drop lines that many documents share, keeping each in one of them.

Lines are exploded with their positions, their normalised keys are hashed to 128 bits, documents
are counted for each hash (partial counts are summed before the shuffle), and what is dropped
meets the document again by its row key, where the other lines are joined by position.

Defined cases: a null or empty text is one empty line; a null doc_id counts as the smallest id;
a row is a document, so rows that repeat a doc_id count each and all rows with the largest id
keep the line; other columns, whatever their names, come back unchanged. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import SPACES, ascii_lower, stored, table


def _keys(text: Column) -> Column:
    """Key of each line: stripped and lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(SPACES)))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(a, b, keeper): hashes of the keys that at least min_docs documents hold, and the largest id."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    long_keys = F.filter(_keys(text), lambda key: F.char_length(key) >= min_chars)
    held = docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.explode(F.array_distinct(F.transform(long_keys, _hashed))).alias("h")
    )
    counted = held.groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(
        F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper")
    )
    return counted.filter(F.col("docs") >= min_docs).select("a", "b", "keeper")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """docs as {doc: all columns, n_lines, n_dropped, kept}; kept is the text without the dropped lines."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # A table of its own: the join then shuffles both sides anew, so Spark can split a hot line's rows.
    frequent = stored(shared_lines(docs, id_col, text_col, min_chars, min_docs), "shared-lines")
    marked = F.transform(_keys(text), lambda key: F.when(F.char_length(key) >= min_chars, _hashed(key)))
    lines = docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("content"), F.posexplode(marked).alias("pos", "h")
    ).filter(F.col("h").isNotNull())
    lines = lines.select("doc", "content", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    dropped = (
        lines.join(frequent, ["a", "b"])
        .filter(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "content")
        .agg(F.collect_set("pos").alias("drop"))
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("left_doc"), F.xxhash64(text).alias("left_content"),
    )
    met = whole.join(
        dropped, F.col("left_doc").eqNullSafe(F.col("doc")) & (F.col("left_content") == F.col("content")), "left"
    )
    body = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    with_lines = met.select("row", "drop", F.split(body, "\n").alias("lines"))
    positions = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), body).otherwise(
        F.array_join(F.transform(positions, lambda p: F.get(F.col("lines"), p)), "\n")
    )
    return with_lines.select(
        F.col("row").alias("doc"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    result = dedup_lines(table(spark, sf_dir, "documents"))
    return result.select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT d.doc_id, d.pos, d.line, f.k IS NOT NULL AND d.doc_id <> f.keeper AS gone
  FROM keyed d LEFT JOIN frequent f ON d.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
