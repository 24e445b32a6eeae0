"""Registered queries: ranked retrieval, expansion, fusion and context budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.catalog import sql as S
from foliograph.catalog.registry import query
from foliograph.operators import graph, index
from foliograph.operators import retrieval as R
from foliograph.operators import segments
from foliograph.session import persist_durably, shared_dir


def _scores(t, k=None):
    q = t.questions
    return R.bm25(q, index.searchable(t.wiki), lengths=R.phrase_lengths(q), k=k)


def _hits(t, k=2 * K.TOP_K):
    return R.ranked(_scores(t, k), k)


def _found(t):
    q = t.questions
    return R.search(q, t.wiki, stemmed=False, lengths=R.phrase_lengths(q))


def _documents(t):
    return t.documents.select(
        F.lit("documents").alias("subdir"), F.col("doc_id").cast("string").alias("name"),
        F.col("lang").alias("type"), F.col("source").alias("tags"), F.col("text").alias("content"),
    )


def _benchmark_queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query("R1_bm25", "SELECT query_id, subdir, name, round(score, 6) AS score FROM scored", S.BM25)
def _(t):
    return _scores(t).withColumn("score", F.round("score", 6))


@query("A8_corpus_stats", "SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM stat", "wiki toks lens stat")
def _(t):
    docs = index.analysed(index.searchable(t.wiki), ["subdir", "name"])
    return index.corpus_stats(docs).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(
    "A7_document_frequency",
    "SELECT term, count(*) AS df FROM (SELECT DISTINCT subdir, name, term FROM tok WHERE NOT contains(term, ' ')) GROUP BY 1",
    "wiki toks tok",
)
def _(t):
    docs = index.analysed(index.searchable(t.wiki), ["subdir", "name"])
    return index.postings(docs, ["subdir", "name"]).groupBy("term").agg(F.count("*").alias("df"))


@query("L1_top_hits", "SELECT query_id, subdir, name, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits", S.BM25 + " hits")
def _(t):
    return _hits(t).withColumn("score", F.round("score", 6))


@query(
    "R2_per_term_best",
    """SELECT query_id, name, round(max(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (subdir, name), stat GROUP BY ALL""",
    S.BM25,
)
def _(t):
    q = t.questions
    return R.per_term_best(q, index.searchable(t.wiki), lengths=R.phrase_lengths(q)).withColumn("score", F.round("score", 6))


def _segmented(t):
    """An index of the wiki after a commit of earlier pages, one that replaces, adds and deletes, and no text since."""
    folder = f"{shared_dir(t.spark)}/wiki-index-{uuid.uuid4().hex}"
    found = segments.SegmentIndex(t.spark, folder, stemmed=False)
    pages = t.wiki.select("subdir", "name", "content")
    h = F.pmod(F.xxhash64("name"), F.lit(10))
    # Earlier: a tenth of the pages is missing, one has other text, and one stands under another name too.
    first = pages.filter(h != 0).withColumn("content", F.when(h == 1, F.concat(F.lit("Earlier nation_1 part line "), F.col("content"))).otherwise(F.col("content")))
    gone = pages.filter(h == 2).withColumn("name", F.concat(F.lit("Former "), F.col("name")))
    found.commit(first.unionByName(gone))
    found.commit(pages.filter(h <= 1), gone.select("subdir", "name"))
    return found


@query(
    "K3_index_segments",
    "SELECT term, count(*) AS df, CAST(sum(f) AS DOUBLE) AS f, CAST(sum(dl) AS BIGINT) AS dl FROM (SELECT subdir, name, term, sum(w) AS f FROM tok WHERE NOT contains(term, ' ') GROUP BY ALL) "
    "JOIN lens USING (subdir, name) GROUP BY term",
    "wiki toks lens tok",
)
def _(t):
    """Postings of the live pages, added up by term."""
    return _segmented(t).postings().groupBy("term").agg(
        F.count("*").alias("df"), F.sum("f").alias("f"), F.sum("dl").alias("dl")
    )


@query("L1_pruned_top", "SELECT query_id, subdir, name, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits", S.BM25 + " hits")
def _(t):
    return segments.top_pages(t.questions, _segmented(t), 2 * K.TOP_K).withColumn("score", F.round("score", 6))


@query("R5_indexed_search", "SELECT query_id, name, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM found", S.SEARCH)
def _(t):
    return segments.search(t.questions, _segmented(t)).withColumn("score", F.round("score", 6))


@query("R3_expansion_hits", "SELECT query_id, name, CAST(hits AS BIGINT) AS hits FROM near", SEARCH_NEAR := S.BM25 + " hits uniq uocc ulinks keys edges nbrs seeds near")
def _(t):
    hits = persist_durably(_hits(t), "hits")
    seeds = hits.filter(F.col("rank") <= K.SEED_COUNT).select("query_id", "name")
    return R.expansion_hits(seeds, graph.unique_pages(t.wiki))


@query(
    "W1_expansion_ranks",
    """SELECT query_id, name, CAST(rank AS INTEGER) AS rank FROM near_ranked n WHERE rank <= 20
    OR EXISTS (SELECT 1 FROM hits h WHERE h.query_id = n.query_id AND h.name = n.name)""",
    S.BM25 + " hits uniq uocc ulinks keys edges nbrs seeds near near_ranked",
)
def _(t):
    hits = persist_durably(_hits(t), "hits")
    seeds = hits.filter(F.col("rank") <= K.SEED_COUNT).select("query_id", "name")
    near = persist_durably(R.expansion_hits(seeds, graph.unique_pages(t.wiki)), "expansion")
    return R.expansion_ranks(near, hits, K.TOP_K)


@query("R5_search", "SELECT query_id, name, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM found", S.SEARCH)
def _(t):
    return _found(t).withColumn("score", F.round("score", 6))


@query(
    "R5_search_without_expansion",
    "SELECT query_id, name, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits WHERE rank <= 20", S.BM25 + " hits",
)
def _(t):
    q = t.questions
    found = R.search(q, t.wiki, expand=False, stemmed=False, lengths=R.phrase_lengths(q))
    return found.withColumn("score", F.round("score", 6))


_DOC_CTES = S.bm25_ctes(
    "doc_id",
    "SELECT doc_id, CAST(doc_id AS VARCHAR) AS f_name, lang AS f_type, source AS f_tags, text AS f_content FROM documents",
    "SELECT item_id AS query_id, text FROM benchmark",
)
# The benchmark texts hold no phrase words, so the two-token rows are left out here.
_DOC_CTES["tok"] = "\nUNION ALL ".join(
    f"SELECT doc_id, {w} AS w, unnest({c}) AS term FROM toks"
    for c, w in (("f_name", 10.0), ("f_type", 3.0), ("f_tags", 5.0), ("f_content", 1.0))
)
_DOC = "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in _DOC_CTES.items())
_DOC_RANKED = (
    "SELECT query_id, CAST(doc_id AS VARCHAR) AS name, score, row_number() OVER (PARTITION BY query_id "
    "ORDER BY round(score, 9) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM scored"
)


@query(
    "R5_document_search",
    f"""{_DOC}, hits AS ({_DOC_RANKED}), cut AS (SELECT query_id, name, 1.0 / (60 + rank) AS score FROM hits WHERE rank <= 40)
    SELECT query_id, name, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, name) AS rank FROM cut) WHERE rank <= 20""",
)
def document_search(t):
    found = R.search_docs(_benchmark_queries(t), _documents(t), None, stemmed=False)
    return found.withColumn("score", F.round("score", 6))


@query("R1_document_bm25", f"{_DOC} SELECT query_id, CAST(doc_id AS VARCHAR) AS name, round(score, 6) AS score FROM scored")
def _(t):
    scores = R.bm25(_benchmark_queries(t), _documents(t))
    return scores.select("query_id", "name", F.round("score", 6).alias("score"))


@query(
    "A6_fusion",
    "SELECT query_id, name, round(sum(1.0 / (60 + rank)), 9) AS score FROM ("
    "SELECT o_custkey AS query_id, o_orderpriority AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders UNION ALL "
    "SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) FROM orders) WHERE rank <= 40 GROUP BY ALL",
)
def _(t):
    from foliograph.operators.grouping import top_k

    lists = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("name"), "o_orderkey", "o_totalprice")
    first = top_k(lists, ["query_id"], [F.col("o_orderkey")], 40)
    second = top_k(lists, ["query_id"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40)
    return R.fuse(first, second).withColumn("score", F.round("score", 9))


@query(
    "J11_results",
    f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, f.name, subdir, round(score, 4) AS score,
    {S.trim("replace(left(b, 200), chr(10), ' ')")} || CASE WHEN length(b) > 200 THEN '...' ELSE '' END AS snippet
    FROM found f JOIN (SELECT subdir, name, {S.body()} AS b FROM uniq) u ON f.name = u.name""",
    S.SEARCH,
)
def _(t):
    return R.results(_found(t), t.wiki)


_KEPT = "SELECT * FROM loaded WHERE place = 1 OR chars <= 4000"


@query(
    "W2_context_budget",
    f"SELECT query_id, CAST(place AS INTEGER) AS place, name, subdir, CAST(chars AS BIGINT) AS chars FROM ({_KEPT})", S.SEARCH + " loaded",
)
def _(t):
    return R.context(_found(t), t.wiki, 4000).drop("content")


_TOTAL = "SELECT *, sum(length(content)) OVER (PARTITION BY query_id) AS total, count(*) OVER (PARTITION BY query_id) AS n FROM (" + _KEPT + ")"


@query(
    "W3_retrimmed_context",
    f"""SELECT query_id, CAST(CASE WHEN total <= 3000 THEN place ELSE np END AS INTEGER) AS place, name FROM (
      SELECT *, row_number() OVER w AS np, sum(length(content)) OVER (w ROWS UNBOUNDED PRECEDING) AS filled FROM ({_TOTAL})
      WINDOW w AS (PARTITION BY query_id ORDER BY NOT contains(left(content, 200), 'type: source'), length(content) DESC, place))
    WHERE total <= 3000 OR np = 1 OR filled <= 3000""",
    S.SEARCH + " loaded",
)
def _(t):
    return R.retrim(R.context(_found(t), t.wiki, 4000), 3000).drop("content")


@query("L7_halved_context", f"SELECT query_id, CAST(place AS INTEGER) AS place, name FROM ({_TOTAL}) WHERE place <= n // 2", S.SEARCH + " loaded")
def _(t):
    return R.halved(R.context(_found(t), t.wiki, 4000)).select("query_id", "place", "name")


@query(
    "P19_context_text",
    f"SELECT query_id, string_agg('# ' || name || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS text FROM ({_KEPT}) GROUP BY 1",
    S.SEARCH + " loaded",
)
def _(t):
    return R.context_text(R.context(_found(t), t.wiki, 4000))


@query(
    "R6_search_and_load",
    """SELECT query_id, count(*) AS n_found, count(*) FILTER (place = 1 OR chars <= 4000) AS n_loaded,
    CAST(max(chars) FILTER (place = 1 OR chars <= 4000) AS BIGINT) AS chars,
    count(*) FILTER (place = 1 OR chars <= 4000) < count(*) AS truncated FROM loaded GROUP BY 1""",
    S.SEARCH + " loaded",
)
def _(t):
    q = t.questions
    return R.search_and_load(q, t.wiki, max_chars=4000, stemmed=False, lengths=R.phrase_lengths(q))


# The published algorithm again, step by step, as SQL over the distinct words.
def _m(x: str, least: int) -> str:
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    return f"regexp_matches({x}, '^(?:{c}(?:{v}{c}){{{least}}}|[aeiou]+{c}(?:{v}{c}){{{least - 1}}}|[aeiou]+y[aeiou]*{c}(?:{v}{c}){{{least - 1}}})')"


def _vowel(x: str) -> str:
    return f"regexp_matches({x}, '^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])')"


def _cvc(x: str) -> str:
    return f"(regexp_matches({x}, '^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$') OR regexp_matches({x}, '[aeiou][^aeiouy]+[aeiouy][^aeiouwxy]$') OR regexp_matches({x}, 'y[^aeiouy]+[aeiouy][^aeiouwxy]$'))"


def _swap(col: str, table: dict[str, str], least: int) -> str:
    whens = " ".join(
        f"WHEN ends_with({col}, '{s}') THEN CASE WHEN {_m(f'left({col}, length({col}) - {len(s)})', least)} THEN left({col}, length({col}) - {len(s)}) || '{r}' ELSE {col} END"
        for s, r in sorted(table.items(), key=lambda kv: -len(kv[0]))
    )
    return f"CASE {whens} ELSE {col} END"


def _porter_sql(words: str) -> str:
    """(word, stem) of the distinct words a subquery yields."""
    from foliograph.functions.porter import STEP2, STEP3, STEP4

    cut = lambda c, n: f"left({c}, length({c}) - {n})"
    step4 = " ".join(
        f"WHEN ends_with(e, '{s}') THEN CASE WHEN {_m(cut('e', len(s)), 2)}{' AND regexp_matches(' + cut('e', 3) + ', ' + S.q('[st]$') + ')' if s == 'ion' else ''} THEN {cut('e', len(s))} ELSE e END"
        for s in sorted(STEP4, key=len, reverse=True)
    )
    return rf"""WITH w AS (SELECT DISTINCT word FROM ({words})),
    f AS (SELECT word, strip_accents(word) AS z FROM w),
    a AS (SELECT *, CASE WHEN ends_with(z, 'sses') OR (ends_with(z, 'ies') AND length(z) > 3) THEN {cut('z', 2)}
        WHEN ends_with(z, 's') AND NOT ends_with(z, 'ss') THEN {cut('z', 1)} ELSE z END AS a FROM f WHERE strlen(z) BETWEEN 3 AND 64),
    b0 AS (SELECT *, CASE WHEN ends_with(a, 'eed') AND length(a) > 3 THEN NULL WHEN ends_with(a, 'ed') AND {_vowel(cut('a', 2))} THEN {cut('a', 2)}
        WHEN ends_with(a, 'ing') AND {_vowel(cut('a', 3))} THEN {cut('a', 3)} END AS s FROM a),
    b AS (SELECT *, CASE WHEN ends_with(a, 'eed') AND length(a) > 3 THEN CASE WHEN {_m(cut('a', 3), 1)} THEN {cut('a', 1)} ELSE a END
        WHEN s IS NULL THEN a WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e'
        WHEN length(s) > 1 AND right(s, 1) = substr(s, length(s) - 1, 1) AND NOT regexp_matches(s, '[aeioulsz]$') THEN {cut('s', 1)}
        WHEN {_m('s', 1)} AND NOT {_m('s', 2)} AND {_cvc('s')} THEN s || 'e' ELSE s END AS b FROM b0),
    c AS (SELECT *, CASE WHEN ends_with(b, 'y') AND {_vowel(cut('b', 1))} THEN {cut('b', 1)} || 'i' ELSE b END AS c FROM b),
    d AS (SELECT *, {_swap('c', STEP2, 1)} AS d FROM c),
    e AS (SELECT *, {_swap('d', STEP3, 1)} AS e FROM d),
    g AS (SELECT *, CASE {step4} ELSE e END AS g FROM e),
    h AS (SELECT *, CASE WHEN ends_with(g, 'e') AND ({_m(cut('g', 1), 2)} OR ({_m(cut('g', 1), 1)} AND NOT {_cvc(cut('g', 1))})) THEN {cut('g', 1)} ELSE g END AS h FROM g)
    SELECT word, CASE WHEN ends_with(h, 'll') AND {_m('h', 2)} THEN {cut('h', 1)} ELSE h END AS stem FROM h
    UNION ALL SELECT word, z FROM f WHERE strlen(z) NOT BETWEEN 3 AND 64"""


_WORDS = f"SELECT unnest({S.tokens('text')}) AS word FROM documents"


@query("T3_porter_stem", _porter_sql(_WORDS))
def _(t):
    from foliograph.functions.porter import stems

    return stems(t.documents.select(F.explode(index.plain_tokens(F.col("text"))).alias("word")))


_STEMMED = dict(_DOC_CTES)
_STEMMED["raw_tok"] = _STEMMED.pop("tok")
_STEMMED["stems"] = _porter_sql("SELECT term AS word FROM raw_tok UNION ALL SELECT term FROM raw_qt")
_STEMMED["raw_qt"] = _STEMMED.pop("qt")
_STEMMED["tok"] = "SELECT doc_id, w, stem AS term FROM raw_tok JOIN stems ON word = term"
_STEMMED["qt"] = "SELECT query_id, stem AS term, sum(times) AS times FROM raw_qt JOIN stems ON word = term GROUP BY ALL"
_ORDER = ("toks", "lens", "stat", "qw", "raw_tok", "raw_qt", "stems", "tok", "qt", "post", "idf", "scored")


@query(
    "R5_stemmed_document_search",
    "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_STEMMED[n]})" for n in _ORDER)
    + f""", hits AS ({_DOC_RANKED}), cut AS (SELECT query_id, name, 1.0 / (60 + rank) AS score FROM hits WHERE rank <= 40)
    SELECT query_id, name, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, name) AS rank FROM cut) WHERE rank <= 20""",
)
def _(t):
    found = R.search_docs(_benchmark_queries(t), _documents(t), None, stemmed=True)
    return found.withColumn("score", F.round("score", 6))


def stemmed_wiki(select: str) -> str:
    """A query over the relations of a search of the wiki, with every word of a term replaced by its stem."""
    parts = {n: S.CTES[n] for n in S.SEARCH.split()}
    parts["raw_tok"], parts["raw_qt"] = parts["tok"], parts["qt"]
    parts["terms"] = "SELECT term FROM raw_tok UNION SELECT term FROM raw_qt"
    parts["stems"] = _porter_sql("SELECT unnest(string_split(term, ' ')) AS word FROM terms")
    parts["stemmed"] = """SELECT term, string_agg(stem, ' ' ORDER BY i) AS stem_term FROM (
      SELECT term, unnest(string_split(term, ' ')) AS word, generate_subscripts(string_split(term, ' '), 1) AS i FROM terms)
      JOIN stems USING (word) GROUP BY term"""
    parts["tok"] = "SELECT subdir, name, w, stem_term AS term FROM raw_tok JOIN stemmed USING (term)"
    parts["qt"] = "SELECT query_id, stem_term AS term, sum(times) AS times FROM raw_qt JOIN stemmed USING (term) GROUP BY ALL"
    order = [n for n in S.SEARCH.split() if n not in ("tok", "qt")]
    at = order.index("post")
    order[at:at] = ["raw_tok", "raw_qt", "terms", "stems", "stemmed", "tok", "qt"]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in order) + " " + select


@query(
    "R5_stemmed_search",
    stemmed_wiki("SELECT query_id, name, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM found"),
)
def _(t):
    q = t.questions
    return R.search(q, t.wiki, lengths=R.phrase_lengths(q)).withColumn("score", F.round("score", 6))
