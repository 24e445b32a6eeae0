"""Batch retrieval: BM25, one-hop link expansion, reciprocal-rank fusion, budgeted context.

Queries are data: every function takes a (query_id, text) relation and answers all of them in
one plan, so Spark's fixed cost is paid once per batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import pages as P
from foliograph.functions.text import trim_ws
from foliograph.operators import graph
from foliograph.operators.grouping import top_k
from foliograph.session import persist_durably
from foliograph.functions.porter import stems
from foliograph.operators.index import analysed, occurrences, plain_tokens, postings, restemmed, searchable


def query_terms(queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(query_id, term, times): word terms of each query, as stems if asked.

    A word with underscores is a phrase of adjacent tokens; a repeated word counts again.
    """
    found = queries.select(
        "query_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(K.WORD + "+"), F.lit(0))).alias("word")
    )
    terms = found.select("query_id", F.array_join(plain_tokens(F.col("word")), " ").alias("term")).filter(F.col("term") != "")
    terms = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    if not stemmed:
        return terms
    return terms.join(restemmed(terms), "term").groupBy("query_id", F.col("stem_term").alias("term")).agg(F.sum("times").alias("times"))


def phrase_lengths(queries: DataFrame) -> list[int]:
    """Phrase lengths the queries use (a handful of integers), always including single words."""
    lengths = queries.select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(K.WORD + "+"), F.lit(0))).alias("word")
    ).select(F.size(F.filter(F.split("word", "_+"), lambda p: p != "")).alias("n"))
    found = lengths.filter("n > 1").distinct().collect()
    return [1, *sorted(r["n"] for r in found)]


def spellings(terms: DataFrame, docs: DataFrame, stemmed: bool, lengths: Sequence[int]) -> DataFrame:
    """(word, term): the words, or adjacent words, of analysed docs that count as each (distinct) term."""
    terms = terms.select("term").distinct()
    if not stemmed:
        return terms.select(F.col("term").alias("word"), "term")
    parts = terms.select("term", F.split("term", " ").alias("parts"))
    wanted = parts.select(F.explode("parts").alias("stem")).distinct()
    tokens = docs.select(F.explode(F.concat(*[c for c in docs.columns if c.startswith("t_")])).alias("word"))
    known = stems(tokens).join(wanted, "stem", "left_semi")
    done, open_ = None, parts.withColumn("word", F.lit(""))
    for i in range(max(lengths)):
        nth = known.select(F.col("word").alias("next"), F.col("stem").alias("part"))
        open_ = open_.filter(F.size("parts") > i).withColumn("part", F.get("parts", F.lit(i))).join(nth, "part")
        open_ = open_.select("term", "parts", F.ltrim(F.concat_ws(" ", "word", "next")).alias("word"))
        whole = open_.filter(F.size("parts") == i + 1).select("word", "term")
        done = whole if done is None else done.unionByName(whole)
    return done


def matching_documents(
    docs: DataFrame, terms: DataFrame, key: Sequence[str], lengths: Sequence[int] = (1,), stemmed: bool = False
) -> tuple[DataFrame, Row]:
    """(key, matched: its postings of queried terms as (dl, term, f), in order), (n_docs, avgdl).

    Texts are dealt by the last column of the key before they are read, so that occurrences meet the words of the
    queries, are counted and gathered in one task, and only matching postings leave it. (The other columns may be
    constants, by which Spark does not group.) The result is stored, since frequencies and scores read it; the
    corpus is counted and measured on the way.
    """
    mark = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit("").alias("term"))  # what every text holds once
    words = persist_durably(spellings(terms, analysed(docs, key), stemmed, lengths).unionByName(mark), "query-words")
    dealt = analysed(docs.repartition(key[-1]), key)
    rows = occurrences(dealt, key, words, lengths).join(words, "word")
    counted = rows.groupBy(*key, "dl", "term").agg(F.sum("weight").alias("f"))
    matched = counted.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("dl", "term", "f"))).alias("matched"))
    stored = persist_durably(matched, "matching-documents")
    marks = stored.select(F.inline(F.filter("matched", lambda m: m["term"] == "")))
    stats = marks.agg(F.sum("f").cast("long").alias("n_docs"), (F.sum(F.col("dl") * F.col("f")) / F.sum("f")).alias("avgdl")).first()
    found = stored.withColumn("matched", F.filter("matched", lambda m: m["term"] != ""))
    return found.filter(F.size("matched") > 0), stats


def weights(terms: DataFrame, n_docs: int, hits: DataFrame) -> DataFrame:
    """(query_id, term, weight): times the inverse document frequency over the matching postings."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    floored = F.when(idf <= 0, F.lit(K.BM25_MIN_IDF)).otherwise(idf)
    return terms.join(df, "term").select("query_id", "term", (F.col("times") * floored).alias("weight"))


def parts(terms: DataFrame, found: DataFrame, stats: Row, key: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    """(query_id, key, term, part): BM25 of every matching term on its own, of found or only of wanted documents.

    Postings are dealt by key once; what queries make of them stays in that task, and a sum by query and key
    sends nothing."""
    hits = found.select(*key, F.inline("matched"))
    if not stats.n_docs or not stats.avgdl:  # nothing can match
        return hits.join(terms, "term").select("query_id", *key, "term", F.lit(0.0).alias("part")).filter(F.lit(False))
    weighted = persist_durably(weights(terms, stats.n_docs, hits), "query-weights")
    norm = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("dl") / stats.avgdl)
    saturated = F.col("f") * (K.BM25_K1 + 1) / (F.col("f") + norm)
    dealt = (found if wanted is None else wanted).repartition(*key).select(*key, F.inline("matched"))
    joined = dealt.select(*key, "term", saturated.alias("part")).join(weighted, "term")
    return joined.select("query_id", *key, "term", (F.col("weight") * F.col("part")).alias("part"))


def bm25(queries: DataFrame, docs: DataFrame, key: Sequence[str] = ("subdir", "name"), stemmed: bool = False,
         lengths: Sequence[int] = (1,), k: int | None = None) -> DataFrame:
    """Scores of all matching documents. ``docs`` holds the key, name, type, tags and content.

    With ``k``, documents that cannot be among the best k of any query by (score, name, subdir) are left out before
    they are scored: those with k earlier names among documents of the very same postings, which score alike."""
    key = list(key)
    terms = persist_durably(query_terms(queries, stemmed), "query-terms")
    found, stats = matching_documents(docs, terms, key, lengths, stemmed)
    wanted = None if k is None else first_alike(found, k)
    return parts(terms, found, stats, key, wanted).groupBy("query_id", *key).agg(F.sum("part").alias("score"))


def first_alike(found: DataFrame, k: int) -> DataFrame:
    """The first k by name of documents with the very same postings. These are compared as one text after its hash, since
    arrays are compared item by item."""
    entry = lambda m: F.concat_ws("\t", m["dl"], m["f"], m["term"])
    alike = found.withColumn("alike", F.concat_ws("\n", F.transform("matched", entry)))
    order = [F.col("name"), F.col("subdir")]
    return top_k(alike.withColumn("hash", F.xxhash64("alike")), ["hash", "alike"], order, k).drop("rank", "hash", "alike")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, subdir, name, score, rank): best ``k`` page files of every query."""
    order = [F.round("score", 9).desc(), F.col("name"), F.col("subdir")]
    return top_k(scores, ["query_id"], order, k)


def per_term_best(queries: DataFrame, docs: DataFrame, stemmed: bool = False, lengths: Sequence[int] = (1,)) -> DataFrame:
    """Fallback ranking: every term (a phrase of one of the lengths too) searched on its own, best score per name,
    not cut."""
    key = ["subdir", "name"]
    each = persist_durably(query_terms(queries, stemmed).withColumn("times", F.lit(1)), "query-terms")
    found, stats = matching_documents(docs, each, key, lengths, stemmed)
    return parts(each, found, stats, key).groupBy("query_id", *key).agg(F.max("part").alias("score")).groupBy(
        "query_id", "name").agg(F.max("score").alias("score"))


# --- link expansion ------------------------------------------------------------------------


def expansion_hits(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, name, hits): pages one link away from a query's seeds, seeds excluded.

    ``hits`` counts seeds, a seed listed twice counting twice. Only edges that touch a seed are
    made symmetric and distinct, never the whole graph.
    """
    links = graph.edges(pages).select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("name"), F.col("dst").alias("neighbour")),
                F.struct(F.col("dst").alias("name"), F.col("src").alias("neighbour")),
            )
        )
    )
    return hits_over(seeds, links, distinct=False)


def hits_over(seeds: DataFrame, links: DataFrame, distinct: bool = True) -> DataFrame:
    """The same over a symmetric (name, neighbour) relation, ``distinct`` if it is so already."""
    counted = seeds.groupBy("query_id", "name").agg(F.count("*").alias("times"))
    touched = counted.join(links, "name")
    touched = touched if distinct else touched.distinct()
    hits = touched.groupBy("query_id", F.col("neighbour").alias("name")).agg(F.sum("times").alias("hits"))
    return hits.join(counted, ["query_id", "name"], "left_anti")


def expansion_ranks(hits: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    """(query_id, name, rank) of the expanded pages that can still reach the fused top ``k``.

    A page found only by its links reaches the top k only with a link rank up to k. A page
    that was also matched by text may hold any rank; its exact rank is one plus the number of
    better neighbours, counted without sorting a hub's neighbours in one place.
    """
    best = top_k(hits, ["query_id"], [F.col("hits").desc(), F.col("name")], k).select("query_id", "name", "rank")
    wanted = hits.join(listed.select("query_id", "name").distinct(), ["query_id", "name"], "left_semi")
    other = wanted.select("query_id", F.col("name").alias("w_name"), F.col("hits").alias("w_hits"))
    better = hits.join(other, "query_id").filter(
        (F.col("hits") > F.col("w_hits")) | ((F.col("hits") == F.col("w_hits")) & (F.col("name") < F.col("w_name")))
    )
    ahead = better.groupBy("query_id", "w_name").agg(F.count("*").alias("ahead"))
    exact = other.join(ahead, ["query_id", "w_name"], "left").select(
        "query_id", F.col("w_name").alias("name"), (F.coalesce("ahead", F.lit(0)) + 1).cast("int").alias("rank")
    )
    return best.unionByName(exact).distinct()


def fuse(*rankings: DataFrame) -> DataFrame:
    """(query_id, name, score): reciprocal ranks summed over all lists."""
    union = rankings[0].select("query_id", "name", "rank")
    for ranking in rankings[1:]:
        union = union.unionByName(ranking.select("query_id", "name", "rank"))
    return union.groupBy("query_id", "name").agg(F.sum(1.0 / (K.RRF_K + F.col("rank"))).alias("score"))


def search(queries: DataFrame, pages: DataFrame, k: int = K.TOP_K, expand: bool = True, stemmed: bool = True,
           lengths: Sequence[int] = (1,)) -> DataFrame:
    """(query_id, name, score, rank): text hits and their link neighbours, fused.

    Queries without any text hit return no rows. Without expansion the scores are BM25.
    """
    return search_docs(queries, searchable(pages), pages, k, expand, stemmed, lengths)


def search_docs(queries: DataFrame, docs: DataFrame, pages: DataFrame | None, k: int = K.TOP_K, expand: bool = True,
                stemmed: bool = True, lengths: Sequence[int] = (1,)) -> DataFrame:
    hits = persist_durably(ranked(bm25(queries, docs, stemmed=stemmed, lengths=lengths, k=2 * k), 2 * k), "hits")
    return finish(hits, pages, k, expand)


def finish(hits: DataFrame, pages: DataFrame | None, k: int, expand: bool) -> DataFrame:
    """Expansion over the links of ``pages``, fusion and final cut."""
    order = [F.round("score", 12).desc(), F.col("name")]
    if not expand:
        return hits.filter(F.col("rank") <= k).select("query_id", "name", "score", "rank")
    rankings = [hits]
    if pages is not None:
        seeds = hits.filter(F.col("rank") <= K.SEED_COUNT).select("query_id", "name")
        near = expansion_hits(seeds, graph.unique_pages(pages.select("subdir", "name", "content")))
        rankings.append(expansion_ranks(persist_durably(near, "expansion"), hits, k))
    return top_k(fuse(*rankings), ["query_id"], order, k).select("query_id", "name", "score", "rank")


# --- context --------------------------------------------------------------------------------


def results(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Search results for display: kind, rounded score and snippet, in rank order."""
    loaded = found.join(graph.unique_pages(pages.select("subdir", "name", "content")), "name")
    return loaded.select(
        "query_id", "rank", "name", "subdir", F.round("score", 4).alias("score"), P.snippet(F.col("content")).alias("snippet")
    )


def context(found: DataFrame, pages: DataFrame, max_chars: int = K.CONTEXT_CHARS) -> DataFrame:
    """Pages that fit the budget: sources first, then the rest, in rank order.

    Stops at the first page that overflows but always keeps one. At most k rows per query.
    """
    loaded = found.join(graph.unique_pages(pages.select("subdir", "name", "content")), "name")
    order = [(F.col("subdir") != "sources").cast("int"), F.col("rank")]
    window = Window.partitionBy("query_id").orderBy(*order)
    filled = F.sum(F.length("content")).over(window.rowsBetween(Window.unboundedPreceding, 0))
    placed = loaded.withColumn("place", F.row_number().over(window)).withColumn("chars", filled)
    kept = placed.filter((F.col("place") == 1) | (F.col("chars") <= max_chars))
    return kept.select("query_id", "place", "name", "subdir", "content", "chars")


def retrim(ctx: DataFrame, max_chars: int = K.CONTEXT_CHARS) -> DataFrame:
    """Second budget pass, only for contexts over budget: sources first, then longest first."""
    group = Window.partitionBy("query_id")
    is_source = F.contains(F.left("content", F.lit(200)), F.lit("type: source"))
    order = group.orderBy(F.when(is_source, 0).otherwise(1), F.length("content").desc(), F.col("place"))
    total = F.sum(F.length("content")).over(group)
    filled = F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = (
        ctx.withColumn("total", total)
        .withColumn("new_place", F.row_number().over(order))
        .withColumn("filled", filled)
    )
    fits = F.col("total") <= max_chars
    kept = rows.filter(fits | (F.col("new_place") == 1) | (F.col("filled") <= max_chars))
    place = F.when(fits, F.col("place")).otherwise(F.col("new_place"))
    return kept.select("query_id", place.alias("place"), "name", "content")


def halved(ctx: DataFrame) -> DataFrame:
    """First half of every context, for a retry after an overflow."""
    size = F.count("*").over(Window.partitionBy("query_id"))
    return ctx.withColumn("n", size).filter(F.col("place") <= F.floor(F.col("n") / 2)).drop("n")


def context_text(ctx: DataFrame) -> DataFrame:
    """(query_id, text): the context pages joined for a prompt. A context is bounded by its budget."""
    page = F.concat(F.lit("# "), F.col("name"), F.lit("\n"), F.col("content"))
    parts = F.sort_array(F.collect_list(F.struct("place", page.alias("page"))))
    joined = F.array_join(F.transform(parts, lambda p: p["page"]), "\n\n---\n\n")
    return ctx.groupBy("query_id").agg(joined.alias("text"))


def search_and_load(queries: DataFrame, pages: DataFrame, k: int = K.TOP_K, max_chars: int = K.CONTEXT_CHARS,
                    stemmed: bool = True, lengths: Sequence[int] = (1,)) -> DataFrame:
    """One row per query with hits: pages found, pages loaded, characters, truncated or not."""
    found = search(queries, pages, k, True, stemmed, lengths)
    loaded = context(found, pages, max_chars)
    sizes = loaded.groupBy("query_id").agg(F.count("*").alias("n_loaded"), F.max("chars").alias("chars"))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n_found"))
    return counts.join(sizes, "query_id", "left").select(
        "query_id",
        "n_found",
        F.coalesce("n_loaded", F.lit(0)).alias("n_loaded"),
        F.coalesce("chars", F.lit(0)).alias("chars"),
        (F.coalesce("n_loaded", F.lit(0)) < F.col("n_found")).alias("truncated"),
    )


def clean_question(queries: DataFrame) -> DataFrame:
    """Drop blank questions, as the search endpoint does."""
    return queries.withColumn("text", trim_ws(F.col("text"))).filter(F.col("text") != "")


__all__ = [
    "bm25", "context", "context_text", "expansion_hits", "expansion_ranks", "fuse", "halved", "per_term_best",
    "phrase_lengths", "postings", "query_terms", "ranked", "results", "retrim", "search", "search_and_load",
    "search_docs", "clean_question",
]
