"""Document fingerprints: threshold-scaled sketches of word shingles.

A document's shingles are its runs of five words (A-Z lower-cased, split at white space; a text of
fewer words has the whole sequence as its only one). The fingerprint keeps every shingle hash
below a fixed share of the hash range, so fingerprints of very unequal documents can be compared
and merged: the union of two is the fingerprint of both texts' shingles. Documents with fewer than
`least` such hashes keep their `least` smallest ones instead (all, if there are no more), which
also merges. Likeness and containment are taken over the hashes up to the smaller of the two
sketches' reaches, where both are complete.

Only DataFrame functions are used, row by row; a document meets the next one in a window over
buckets of consecutive ids, with the first row of each bucket repeated at the end of the one before.

Defined cases: a null text is an empty one; texts without words have an empty fingerprint, which is
as like (1) only to another empty one; rows that repeat an id follow one another by descending
text; null ids come last; other columns come back unchanged in `doc`. With one row, that row is
its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import ascii_lower, packed, partitions, space_words, table, unpacked

WORDS = 5
SHARE = 1 / 16
LEAST = 64
TOP = (1 << 63) - 1


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """Distinct 64-bit hashes (signed) of the shingles of an array of words."""
    n = F.size(words)
    each = F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    )
    whole = F.array(F.xxhash64(words))  # of the array: words may hold any separator
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.when(n >= size, each).when(n > 0, whole).otherwise(none))


def _bound(share: float) -> int:
    return -(1 << 63) + int(share * (1 << 64)) if share < 1 else TOP


def sketch_of(hashes: Column, share: float = SHARE, least: int = LEAST) -> Column:
    """Sorted hashes that the fingerprint keeps, from distinct hashes."""
    below = F.filter(hashes, lambda h: h < _bound(share))
    return F.when(F.size(below) >= least, F.array_sort(below)).otherwise(F.slice(F.array_sort(hashes), 1, least))


def reach(sketch: Column, share: float = SHARE, least: int = LEAST) -> Column:
    """The hash up to which a sketch is complete."""
    last = F.element_at(sketch, -1)
    return F.when(F.size(sketch) < least, F.lit(TOP)).otherwise(F.greatest(last, F.lit(_bound(share) - 1)))


def _shared(a: Column, b: Column, share: float, least: int) -> tuple[Column, Column, Column]:
    limit = F.least(reach(a, share, least), reach(b, share, least))
    cut = lambda s: F.filter(s, lambda h: h <= limit)
    return F.size(F.array_intersect(cut(a), cut(b))), F.size(cut(a)), F.size(cut(b))


def likeness(a: Column, b: Column, share: float = SHARE, least: int = LEAST) -> Column:
    """Estimated Jaccard likeness of the documents of two sketches."""
    both, na, nb = _shared(a, b, share, least)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.coalesce(F.try_divide(both.cast("double"), (na + nb - both).cast("double")), F.lit(0.0))
    )


def containment(a: Column, b: Column, share: float = SHARE, least: int = LEAST) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    both, na, _ = _shared(a, b, share, least)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.coalesce(F.try_divide(both.cast("double"), na.cast("double")), F.lit(0.0)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, text_col: str = "text", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """{doc: all columns, sketch: array<long>}."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body")
    )
    return with_sketch(rows, "body", "sketch", share, least).drop("body")


def merged(sketches: DataFrame, key: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The fingerprints of the united documents of each key, as rows (key, hash): each hash once,
    never gathered in one row. Hashes over the fixed share stay only among a key's `least` smallest."""
    hashes = sketches.select(F.col(key), F.explode("sketch").alias("hash")).distinct()
    bound = _bound(share)
    below = hashes.filter(F.col("hash") < bound)
    counts = below.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    above = hashes.filter(F.col("hash") >= bound)
    short = above.join(counts.filter(F.col("n") >= least), key, "left_anti").join(counts, key, "left")
    # Only keys with fewer than `least` hashes below the bound get here; each part keeps few rows.
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("hash")))
    return below.union(ranked.filter(F.col("rank") + F.coalesce("n", F.lit(0)) <= least).select(key, "hash"))


def with_next(rows: DataFrame, columns: list[str], id_col: str, text_col: str, derive, buckets: int) -> DataFrame:
    """derive(rows) with `next_<c>` of the following row by descending id.

    Bucket limits are quantiles of the ids; at most 2 * `buckets` numbers go to the driver."""
    ids = rows.select(F.col(id_col).alias("_id"))
    steps = [i / buckets for i in range(1, buckets)]
    limits = sorted(set(ids.agg(F.percentile_approx("_id", steps, 100 * buckets).alias("q")).first().q or [])) if steps else []
    above = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x < F.col("_id"))) if limits else F.lit(0)
    bucket = F.when(F.col("_id").isNull(), 0).otherwise(above + 1)
    seen = sorted((r.bucket, r.first) for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("_id").alias("first")).collect())
    # The first row of a bucket is also a guest at the end of the one whose ids are next larger; the
    # very first row is one in the last bucket.
    first_of, host_of = [None] * (len(limits) + 2), [None] * (len(limits) + 2)
    for (number, first), (host, _) in zip(seen, seen[1:] + seen[:1], strict=True):
        first_of[number], host_of[number] = first, host
    as_array = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    first = F.get(as_array(first_of, "bigint"), F.col("bucket"))
    host = F.get(as_array(host_of, "int"), F.col("bucket"))
    named = rows.withColumn("_id", F.col(id_col)).withColumn("bucket", bucket)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.when(F.col("_id").eqNullSafe(first), F.struct(host.alias("bucket"), F.lit(1).alias("guest")))
    placed = named.withColumn("place", F.explode(F.array_compact(F.array(own, guest))))
    placed = placed.withColumns({"bucket": F.col("place.bucket"), "guest": F.col("place.guest")}).drop("place")
    # Dealt out before columns are derived, so that these are never shuffled.
    dealt = derive(placed.repartition("bucket"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("_id").desc_nulls_last(), F.col(text_col).desc_nulls_last())
    followed = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return followed.filter("guest = 0").drop("bucket", "guest", "_id")


def with_sketch(rows: DataFrame, text_col: str, name: str, share: float, least: int) -> DataFrame:
    """rows with the fingerprint of a text column; the steps stay apart so that none is repeated."""
    names = rows.columns
    split = rows.withColumn("_words", space_words(ascii_lower(F.col(text_col))))
    hashed = split.select(*names, shingle_hashes(F.col("_words")).alias("_hashes"))
    return hashed.select(*names, sketch_of(F.col("_hashes"), share, least).alias(name))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, least: int = LEAST,
                 buckets: int | None = None) -> DataFrame:
    """Each document with its edited text (its last third replaced by the beginning of the next
    document by descending id) and their fingerprints: {doc, n_chars, edited, sketch, edited_sketch,
    next_sketch}."""
    buckets = buckets or min(4 * partitions(docs.sparkSession), 1000)
    rows = packed(
        docs, text_col, F.col(f"`{id_col}`").alias("own_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
    )
    met = with_next(
        rows, ["body", "sketch"], "own_id", "body", lambda df: with_sketch(df, "body", "sketch", share, least), buckets
    )
    n = F.char_length("body")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left(F.col("body"), n - cut), F.left(F.col("next_body"), cut))
    both = met.select("doc", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return unpacked(with_sketch(both, "edited", "edited_sketch", share, least))


def query(spark, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    sketch, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc.doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(sketch).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        likeness(sketch, edited).alias("near_edited"), likeness(sketch, following).alias("near_next"),
        containment(sketch, edited).alias("held_by_edited"),
    )
