"""Benchmark decontamination over a distributed positional inverted index.

1. Terms are counted over all documents (partial counts are summed before the shuffle), only for
   words of the test items; of each item's windows the rarest and the next rarest term are chosen.
2. The index stores the postings (term, doc, position) of the chosen terms over all documents.
3. From the rarest term of a window, its list is intersected with that of the next rarest, shifted
   by their distance in the item: what is left are alignments (document, item, position of the
   item's first word). Exact phrases, and words near each other, are then read off the documents
   of these alignments, which are few.
4. For words near each other, terms are chosen among those that do occur: a window gives the pairs of
   its three rarest, and the distance of a pair may differ by `slop` words. So a window with words put
   in, left out or changed still has an alignment, if two of its three stand about where they should.

Words are runs of A-Z (lower-cased), digits and non-ASCII characters. A window is `window`
consecutive words of an item; an item with fewer words, but not none, is one window. A document's
word is hit if it lies in an occurrence of a window. Only DataFrame functions are used.

Items with equal words are looked up once. The chosen terms are joined to the documents' words as
a table in blocks of at most `block` windows, so what is broadcast has a fixed bound however many
items there are; each block is a pass over the documents.

Defined cases: null texts have no words; items without words match nothing; rows that repeat a
document id with the same text give one answer for each row; a null id is an id like others;
rows that repeat an item id are separate texts of one item; other columns come back unchanged in
`doc`. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import ascii_lower, stored, table

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words of a text in order."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS)
    return F.filter(parts, lambda w: w != "")


def test_texts(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(text, words) of the distinct word sequences, and (item, text) of the items that hold them."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), item_words(F.col(f"`{text_col}`")).alias("words"))
    rows = rows.filter(F.size("words") > 0).withColumn("text", F.left(F.sha2(F.concat_ws(" ", "words"), 256), F.lit(32)))
    owners = rows.select("item", "text").distinct()
    return rows.select("text", "words").dropDuplicates(["text"]), owners


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, content, body): the key of a row is its id with a hash of its text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("content"), text.alias("body"))


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over all documents for the given terms; those that never occur have no row."""
    tokens = rows.select(F.explode(item_words(F.col("body"))).alias("term"))
    return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _windows(texts: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(text, start, terms): the terms (n, place, term) of each window, rarest first."""
    places = texts.select("text", F.size("words").alias("length"), F.posexplode("words").alias("place", "term"))
    known = places.join(counts, "term", "left").select("text", "length", "place", "term", F.coalesce("n", F.lit(0)).alias("n"))
    span = F.least(F.lit(window), F.col("length"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - span + 1), F.least(F.col("place"), F.col("length") - span))
    return known.withColumn("start", F.explode(starts)).groupBy("text", "start").agg(
        F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("terms")  # `window` entries at most
    )


def anchors(texts: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(text, first, second, first_term, second_term): for each window the places in its text of its
    rarest and next rarest term (the same if it has one word). Windows with a term that never occurs
    cannot match and have none."""
    windows = _windows(texts, counts, window)
    first, second = F.get("terms", F.lit(0)), F.coalesce(F.get("terms", F.lit(1)), F.get("terms", F.lit(0)))
    return windows.filter(first["n"] > 0).select(
        "text", first["place"].alias("first"), second["place"].alias("second"),
        first["term"].alias("first_term"), second["term"].alias("second_term"),
    ).distinct()


def near_anchors(texts: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Rows like those of anchors: for each window the pairs of its three rarest terms among those that
    occur; the only one with itself."""
    known = _windows(texts, counts, window).select("text", F.filter("terms", lambda t: t["n"] > 0).alias("terms")).filter(F.size("terms") > 0)
    one, two, three = (F.get("terms", F.lit(i)) for i in range(3))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pairs = F.filter(F.array(pair(one, F.coalesce(two, one)), pair(one, three), pair(two, three)), lambda p: p["y"].isNotNull())
    return known.select("text", F.explode(pairs).alias("p")).select(
        "text", F.col("p.x.place").alias("first"), F.col("p.y.place").alias("second"),
        F.col("p.x.term").alias("first_term"), F.col("p.y.term").alias("second_term"),
    ).distinct()


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional inverted index of the given terms, stored: (term, doc, content, place)."""
    tokens = rows.select("doc", "content", F.posexplode(item_words(F.col("body"))).alias("place", "term"))
    return stored(tokens.join(F.broadcast(terms), "term").select("term", "doc", "content", "place"), "postings")


def alignments(index: DataFrame, chosen: DataFrame, slop: int = 0) -> DataFrame:
    """(doc, content, text, base): where the two terms of a window stand at their distance, or up to `slop` words
    more or less; base is where the first one puts the text."""
    pairs = F.broadcast(chosen.withColumn("pair", F.xxhash64("text", "first", "second")))  # bounded by the block
    rare = index.join(pairs, F.col("term") == F.col("first_term")).select(
        "doc", "content", "text", "pair", (F.col("place") - F.col("first")).alias("base")
    )
    other = index.join(pairs, F.col("term") == F.col("second_term")).select(
        F.col("doc").alias("d"), F.col("content").alias("c"), F.col("pair").alias("p"), (F.col("place") - F.col("second")).alias("b")
    )
    if slop:
        other = other.withColumn("b", F.explode(F.sequence(F.col("b") - slop, F.col("b") + slop)))
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")) & (F.col("pair") == F.col("p")) & (F.col("base") == F.col("b"))
    return rare.join(other, same, "left_semi").select("doc", "content", "text", "base").distinct()


def _met(rows: DataFrame, places: DataFrame, texts: DataFrame, around: int = 0) -> DataFrame:
    """Alignments with the words of the text (`wanted`) and those of the document from `around` words
    before the place where the text would begin to as many after its end (`found`, from `low`)."""
    lengths = F.broadcast(texts.select("text", F.size("words").alias("length")))  # bounded by the block
    by_doc = places.join(lengths, "text").groupBy("doc", "content").agg(F.collect_set(F.struct("text", "base", "length")).alias("places"))
    own = stored(by_doc.select(F.col("doc").alias("d"), F.col("content").alias("c"), "places"), "aligned-documents")
    held = rows.join(own, F.col("doc").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")))
    held = held.select("doc", "content", "places", item_words(F.col("body")).alias("words"))
    each = held.select("doc", "content", "words", F.explode("places").alias("at"))
    low = F.greatest(F.col("at.base") - around, F.lit(0))
    cut = F.slice("words", low + 1, F.greatest(F.col("at.base") + F.col("at.length") + around - low, F.lit(0)))
    found = each.select("doc", "content", F.col("at.text").alias("text"), F.col("at.base").alias("base"), low.alias("low"), cut.alias("found"))
    return found.join(F.broadcast(texts.select("text", F.col("words").alias("wanted"))), "text")


def phrase_hits(rows: DataFrame, places: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(doc, content, text, start, end): occurrences of windows in documents, end not included."""
    met = _met(rows, places, texts)
    shift = F.col("base") - F.col("low")  # negative where the text's beginning lies before the document's
    n = F.size("wanted")
    span = F.least(F.lit(window), n)
    same = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(
            F.when(i + shift >= 0, F.get(F.col("found"), i + shift) == F.get(F.col("wanted"), i)), F.lit(False)
        )
    )
    marked = met.select("doc", "content", "text", "base", span.alias("span"), same.alias("same"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("same") - F.col("span")), lambda s: F.forall(F.slice(F.col("same"), s + 1, F.col("span")), lambda x: x)
    )
    hits = marked.select("doc", "content", "text", "base", "span", F.explode(starts).alias("s")).withColumn("start", F.col("base") + F.col("s"))
    return hits.select("doc", "content", "text", "start", (F.col("start") + F.col("span")).alias("end")).distinct()


def proximity_hits(rows: DataFrame, places: DataFrame, texts: DataFrame, slop: int, least_share: float) -> DataFrame:
    """(doc, content, text, base, share): alignments where at least `least_share` of the text's distinct
    words stand within `slop` words of where the text would lie."""
    met = _met(rows, places, texts, slop)
    wanted = F.array_distinct("wanted")
    share = F.size(F.array_intersect(wanted, "found")) / F.size(wanted)
    return met.select("doc", "content", "text", "base", share.alias("share")).filter(F.col("share") >= least_share)


def blocks_of(texts: DataFrame, window: int, block: int) -> list[DataFrame]:
    """texts in blocks of about at most `block` words (so, of windows)."""
    size = texts.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    count = -(-size // block) if size else 1
    if count <= 1:
        return [texts]
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(count))
    return [texts.filter(part == i) for i in range(count)]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = 13, block: int = 500_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, texts, owners): occurrences of windows as of phrase_hits, stored, and whose they are."""
    texts, owners = test_texts(benchmark, item_col, item_text_col)
    texts, owners = stored(texts, "test-texts"), stored(owners, "test-owners")
    rows = keyed(docs, id_col, text_col)
    hits = None
    for part in blocks_of(texts, window, block):
        terms = part.select(F.explode("words").alias("term")).distinct()
        chosen = stored(anchors(part, term_counts(rows, terms), window), "anchors")
        wanted = chosen.select(F.explode(F.array("first_term", "second_term")).alias("term")).distinct()
        index = postings(rows, wanted)
        places = stored(alignments(index, chosen), "alignments")
        found = phrase_hits(rows, places, part, window)
        hits = found if hits is None else hits.union(found)
    return stored(hits, "hits"), texts, owners


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 13, words_per_hit: int = 20,
                  block: int = 500_000) -> DataFrame:
    """{doc: all columns, n_words, n_hit, items: sorted item ids as strings, contaminated}. A document is
    contaminated if it has hit words, and no more than `words_per_hit` words for each of them."""
    hits, _, owners = find(docs, benchmark, id_col, text_col, item_col, item_text_col, window, block)
    # Words hit, each once: occurrences overlap, so they are first joined to runs.
    order = Window.partitionBy("doc", "content").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    spans = hits.select("doc", "content", "start", "end").distinct()
    words_hit = spans.withColumn("fresh", fresh).groupBy("doc", "content").agg(F.sum("fresh").alias("n_hit"))
    found = hits.select("doc", "content", "text").distinct().join(owners, "text")
    items = found.groupBy("doc", "content").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    both = words_hit.join(
        items.select(F.col("doc").alias("d"), F.col("content").alias("c"), "items"),
        F.col("doc").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left",
    ).select(F.col("doc").alias("hit_doc"), F.col("content").alias("hit_content"), "n_hit", "items")
    both = stored(both, "contaminated")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("own"),
        F.xxhash64(text).alias("content"), F.size(item_words(text)).cast("long").alias("n_words"),
    )
    met = rows.join(both, F.col("own").eqNullSafe(F.col("hit_doc")) & (F.col("content") == F.col("hit_content")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return met.select(
        "doc", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (words_per_hit * F.col("n_hit") >= F.col("n_words")))


def find_near(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = 13, slop: int = 3, least_share: float = 0.8,
              block: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(near, owners): alignments as of proximity_hits, stored, and whose texts they are of."""
    texts, owners = test_texts(benchmark, item_col, item_text_col)
    texts, owners = stored(texts, "near-texts"), stored(owners, "near-owners")
    rows = keyed(docs, id_col, text_col)
    near = None
    for part in blocks_of(texts, window, block):
        terms = part.select(F.explode("words").alias("term")).distinct()
        chosen = stored(near_anchors(part, term_counts(rows, terms), window), "near-anchors")
        wanted = chosen.select(F.explode(F.array("first_term", "second_term")).alias("term")).distinct()
        places = stored(alignments(postings(rows, wanted), chosen, slop), "near-alignments")
        found = proximity_hits(rows, places, part, slop, least_share)
        near = found if near is None else near.union(found)
    return stored(near, "near-hits"), owners


def near_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = 13, slop: int = 3, least_share: float = 0.8, block: int = 500_000) -> DataFrame:
    """{doc: all columns, near: sorted ids of the items near in it as strings, share: the highest or null}."""
    hits, owners = find_near(docs, benchmark, id_col, text_col, item_col, item_text_col, window, slop, least_share, block)
    best = hits.groupBy("doc", "content", "text").agg(F.max("share").alias("share")).join(owners, "text")
    found = best.groupBy(F.col("doc").alias("d"), F.col("content").alias("c")).agg(
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("near"), F.max("share").alias("share")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("own"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("content"),
    )
    met = rows.join(stored(found, "near-items"), F.col("own").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left")
    return met.select("doc", F.coalesce("near", F.array().cast("array<string>")).alias("near"), "share")


def near_query(spark, sf_dir: str) -> DataFrame:
    result = near_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return result.select(
        "doc.doc_id", F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ",").cast("binary"), 256).alias("near_sha256"), "share",
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    result = decontaminate(docs.select("doc_id", "text"), benchmark)
    return result.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
windows AS (
  SELECT item_id, least(13, len(words)) AS n, unnest(list_transform(range(1, greatest(len(words) - 13, 0) + 2),
    lambda i: array_to_string(list_slice(words, i, i + least(13, len(words)) - 1), ' '))) AS w
  FROM bw WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
dwin AS (
  SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i, words FROM dw, sizes WHERE len(words) >= n),
hits AS (
  SELECT doc_id, i, d.n, item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w FROM dwin) d
  JOIN windows USING (w, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
