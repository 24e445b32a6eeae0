"""Registered queries: page parsing (P), text kernel (T) and predicates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.catalog import sql as S
from foliograph.catalog.registry import query
from foliograph.functions import pages as P
from foliograph.functions import text as T

def c():
    return F.col("content")


def _join(c):
    return F.array_join(c, "|")


@query("P1_frontmatter", f"SELECT subdir, name, {S.fm()} AS fm FROM wiki", "wiki")
def _(t):
    return t.wiki.select("subdir", "name", P.frontmatter(c()).alias("fm"))


@query("P2_body", f"SELECT subdir, name, {S.body()} AS body FROM wiki", "wiki")
def _(t):
    return t.wiki.select("subdir", "name", P.body(c()).alias("body"))


@query(
    "P3_searched_fields",
    rf"""SELECT subdir, name, {S.trim(rf"regexp_extract({S.fm()}, 'type:\s*([^\n]+)', 1)")} AS type,
    {S.trim(rf"regexp_extract({S.fm()}, 'tags:\s*\[([^\]]*)\]', 1)")} AS tags FROM wiki""",
    "wiki",
)
def _(t):
    return t.wiki.select("subdir", "name", P.searched_type(c()).alias("type"), P.searched_tags(c()).alias("tags"))


@query(
    "P4_page_meta",
    f"""SELECT subdir, name, {S.first_tag()} AS type, {S.description()} AS description,
    array_to_string(list_filter(list_transform(string_split(regexp_extract({S.field('source_dates')}, '\\[([^\\]]*)\\]', 1), ','),
      lambda v: {S.trim('v')}), lambda v: v <> ''), '|') AS source_dates FROM wiki""",
    "wiki",
)
def _(t):
    return t.wiki.select(
        "subdir", "name", P.first_tag(c()).alias("type"), P.description(c()).alias("description"),
        _join(P.source_dates(c())).alias("source_dates"),
    )


@query(
    "P5_field_map",
    rf"""WITH lines AS (SELECT subdir, name, unnest(string_split({S.fm()}, chr(10))) AS line,
        generate_subscripts(string_split({S.fm()}, chr(10)), 1) AS i FROM wiki),
    kv AS (SELECT subdir, name, i, {S.trim("regexp_extract(line, '^([^:]*):', 1)")} AS key,
        {S.trim("regexp_replace(line, '^[^:]*:', '')")} AS value FROM lines WHERE contains(line, ':')),
    last AS (SELECT *, row_number() OVER (PARTITION BY subdir, name, key ORDER BY i DESC) AS rn FROM kv)
    SELECT subdir, name, key, value, array_to_string({S.list_items('value')}, '|') AS items FROM last WHERE rn = 1""",
    "wiki",
)
def _(t):
    fields = t.wiki.select("subdir", "name", F.explode(P.field_map(c())).alias("key", "value"))
    return fields.withColumn("items", _join(P.list_items(F.col("value"))))


@query(
    "P6_list_fields",
    "SELECT subdir, name, "
    + ", ".join(f"array_to_string({S.anchored(f)}, '|') AS {f}" for f in ("sources", "source_dates", "tags"))
    + " FROM wiki",
    "wiki",
)
def _(t):
    return t.wiki.select(
        "subdir", "name", *[_join(P.anchored_list(c(), f)).alias(f) for f in ("sources", "source_dates", "tags")]
    )


@query("P7_first_paragraph", f"SELECT subdir, name, {S.description()} AS description FROM wiki", "wiki")
def _(t):
    return t.wiki.select("subdir", "name", P.description(c()).alias("description"))


_CUT = r"'(?:^|\n)(?:###\s+From\s+\[\[|##\s+(?i:mentioned)\s+(?i:in))'"


@query(
    "P8_registry_paragraph",
    rf"""WITH untitled AS (SELECT subdir, name, regexp_replace({S.raw_body()}, '(^|\n)#\s+[^\n]*\n', '\1') AS t FROM wiki),
    cut AS (SELECT subdir, name, regexp_split_to_array(t, {_CUT})[1] AS t FROM untitled)
    SELECT subdir, name, {S.squeeze(f"coalesce(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {S.trim('p')}), lambda p: p <> '' AND NOT starts_with(p, '>'))[1], '')")} AS paragraph FROM cut""",
    "wiki",
)
def _(t):
    return t.wiki.select("subdir", "name", P.registry_paragraph(c()).alias("paragraph"))


@query("P9_link_targets", "SELECT subdir, src AS name, link_text FROM links", "wiki occ links")
def _(t):
    return t.wiki.select("subdir", "name", F.explode(P.link_targets(c())).alias("link_text"))


@query(
    "P10_link_occurrences",
    f"""SELECT subdir, name, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS occ, unnest(l) AS link_text
    FROM (SELECT subdir, name, regexp_extract_all(content, '{S.LINK}', 1) AS l FROM wiki)""",
    "wiki",
)
def _(t):
    return t.wiki.select("subdir", "name", F.posexplode(P.link_occurrences(c())).alias("occ", "link_text"))


# Web pages carry hrefs instead of wikilinks: the same extraction and resolution on raw HTML.
_HREF = r"""href="([^"]*)\""""


@query(
    "P10_href_occurrences",
    f"""SELECT page_id, link, count(*) AS n FROM (
        SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS link FROM pages) GROUP BY ALL""",
)
def _(t):
    links = t.web_pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(
    "P11_source_markers",
    f"""WITH m AS (SELECT name, unnest(list_filter(list_transform(regexp_extract_all(content, '{K.SOURCE_MARKER}', 1),
        lambda f: {S.trim('f')}), lambda f: f <> '')) AS filename,
        regexp_extract(content, '(?m)^source_hash:\\s*([a-f0-9]{{64}})\\s*$', 1) AS source_hash
        FROM wiki WHERE subdir = 'sources')
    SELECT filename, max(name) AS source_page, max_by(source_hash, name) AS source_hash FROM m GROUP BY filename""",
    "wiki",
)
def _(t):
    from foliograph.operators.index import raw_file_index

    return raw_file_index(t.wiki)


@query(
    "P12_snippet",
    f"""SELECT subdir, name, {S.trim("replace(left(b, 200), chr(10), ' ')")} || CASE WHEN length(b) > 200 THEN '...' ELSE '' END AS snippet
    FROM (SELECT subdir, name, {S.body()} AS b FROM wiki)""",
    "wiki",
)
def _(t):
    return t.wiki.select("subdir", "name", P.snippet(c()).alias("snippet"))


@query(
    "P12_document_snippet",
    f"""SELECT doc_id, {S.trim("replace(left(b, 200), chr(10), ' ')")} || CASE WHEN length(b) > 200 THEN '...' ELSE '' END AS snippet
    FROM (SELECT doc_id, {S.body('text')} AS b FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", P.snippet(F.col("text")).alias("snippet"))


_B = "(" + S.in_list("s", K.BOILERPLATE_HEADINGS) + ")"


@query(
    "P13_substance",
    rf"""WITH RECURSIVE cut AS (SELECT subdir, name, CASE WHEN starts_with(content, '---') AND instr(substr(content, 4), '---') > 0
          THEN substr(content, 4 + instr(substr(content, 4), '---') + 2) ELSE content END AS t FROM wiki),
    ln AS (SELECT subdir, name, list_filter(list_transform(string_split(t, chr(10)), lambda l: {S.trim('l')}), lambda l: l <> '') AS ls FROM cut),
    fold AS (SELECT subdir, name, ls, 0 AS i, '' AS acc, false AS bp FROM ln
        UNION ALL
        SELECT subdir, name, ls, i + 1,
          CASE WHEN starts_with(s, '# ') AND acc = '' THEN acc WHEN {_B} THEN acc
               WHEN bp AND starts_with(s, '- [[') THEN acc WHEN acc = '' THEN s ELSE acc || chr(10) || s END,
          CASE WHEN starts_with(s, '# ') AND acc = '' THEN bp WHEN {_B} THEN true WHEN bp AND starts_with(s, '- [[') THEN true ELSE false END
        FROM (SELECT *, ls[i + 1] AS s FROM fold WHERE i < len(ls)))
    SELECT subdir, name, acc AS text FROM fold WHERE i = len(ls)""",
    "wiki",
)
def _(t):
    return t.wiki.select("subdir", "name", P.substance(c()).alias("text"))


def _first_sentence_sql(x):
    masked = S.trim(x)
    for a in K.ABBREVIATIONS:
        masked = f"replace({masked}, {S.q(a)}, {S.q(a.replace('.', '§'))})"
    return masked


@query(
    "P14_first_sentence",
    rf"""SELECT doc_id, replace(CASE WHEN h = '' THEN m ELSE h END, '§', '.') AS sentence FROM (
      SELECT doc_id, m, regexp_extract(m, '^([\s\S]*?[.!?])(?:{K.WS}|\z)', 1) AS h
      FROM (SELECT doc_id, {_first_sentence_sql('text')} AS m FROM documents))""",
)
def _(t):
    return t.documents.select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query(
    "P15_highlight",
    "SELECT doc_id, regexp_replace(text, '(?i)(which|that|the|and)', '<strong>\\1</strong>', 'g') AS text FROM documents",
)
def _(t):
    return t.documents.select("doc_id", T.highlight(F.col("text"), "The that AND which the").alias("text"))


@query(
    "P16_title",
    f"""SELECT page_id, {S.safe_name("CASE WHEN length(tt) >= 5 AND tt <> f THEN tt ELSE array_to_string(list_transform(string_split(translate(regexp_replace(f, '[.][^.]*$', ''), '-_', '  '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') END")} AS title
    FROM (SELECT page_id, {S.trim("CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END")} AS tt,
      'my-page_' || page_id || '.v2.html' AS f FROM pages)""",
)
def _(t):
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    filename = F.concat(F.lit("my-page_"), F.col("page_id").cast("string"), F.lit(".v2.html"))
    return t.web_pages.select("page_id", T.source_title(title, filename).alias("title"))


@query(
    "P17_human_size",
    """SELECT page_id, CASE WHEN n > 1000000 THEN printf('%.1f MB', n / 1000000.0) WHEN n > 1000 THEN printf('%.1f KB', n / 1000.0)
       ELSE printf('%d B', n) END AS size FROM (SELECT page_id, length(html) * (page_id % 1500) AS n FROM pages)""",
)
def _(t):
    return t.web_pages.select("page_id", T.human_size(F.length("html") * (F.col("page_id") % 1500)).alias("size"))


# --- text kernel -----------------------------------------------------------------------------


@query(
    "T1_stem",
    f"""SELECT word, {S.stem('word')} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)""",
)
def _(t):
    found = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return found.distinct().select("word", T.stem(F.col("word")).alias("stem"))


@query(
    "T2_content_stems",
    f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, array_to_string(list_sort(s), ' ') AS stems FROM (SELECT doc_id, {S.stems('text')} AS s FROM documents)",
)
def _(t):
    stems = t.documents.select("doc_id", T.content_stems(F.col("text")).alias("s"))
    return stems.select("doc_id", F.size("s").alias("n"), F.array_join(F.array_sort("s"), " ").alias("stems"))


@query("T4_alias_key", f"SELECT subdir, name, {S.alias_key('name')} AS key FROM wiki", "wiki")
def _(t):
    return t.wiki.select("subdir", "name", T.alias_key(F.col("name")).alias("key"))


@query(
    "T4_document_alias_key", f"SELECT doc_id, {S.alias_key('text')} AS key FROM documents",
)
def _(t):
    return t.documents.select("doc_id", T.alias_key(F.col("text")).alias("key"))


@query(
    "T5_strip_parens",
    f"SELECT subdir, name, {S.strip_parens(chr(110) + 'ame' + ' || ' + S.q(' (a) (b c)'))} AS bare FROM wiki", "wiki",
)
def _(t):
    stacked = F.concat(F.col("name"), F.lit(" (a) (b c)"))
    return t.wiki.select("subdir", "name", T.strip_trailing_parens(stacked).alias("bare"))


@query("T6_dedup_key", f"SELECT subdir, name, {S.dedup_key('name')} AS key FROM wiki", "wiki")
def _(t):
    return t.wiki.select("subdir", "name", T.dedup_key(F.col("name")).alias("key"))


@query("T6_document_dedup_key", f"SELECT doc_id, {S.dedup_key('text')} AS key FROM documents")
def _(t):
    return t.documents.select("doc_id", T.dedup_key(F.col("text")).alias("key"))


@query("T7_safe_name", f"SELECT page_id, {S.safe_name('url')} AS from_url, {S.safe_name('html')} AS from_html FROM pages")
def _(t):
    return t.web_pages.select(
        "page_id", T.safe_name(F.col("url")).alias("from_url"), T.safe_name(F.col("html")).alias("from_html")
    )


@query("T8_year", f"SELECT o_orderkey, {S.year('CAST(o_orderdate AS VARCHAR)')} AS year FROM orders")
def _(t):
    return t.orders.select("o_orderkey", T.year_of(F.col("o_orderdate").cast("string")).alias("year"))


_FNAME = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') || '-log.txt' WHEN 1 THEN 'x2019_07 log.txt' WHEN 2 THEN '1850-log.txt' ELSE 'log.txt' END"
_FTEXT = "CASE WHEN event_id % 3 = 0 THEN 'released (2017) as x1999' ELSE event_type || ' id ' || event_id END"


@query(
    "T9_source_date",
    rf"""WITH f AS (SELECT event_id, ts, {_FNAME} AS fname, {_FTEXT} AS txt FROM events),
    p AS (SELECT *, regexp_extract(fname, '^[^0-9]?(\d{{4}})(?:[-_](\d{{2}}))?(?:[-_](\d{{2}}))?', ['y','m','d']) AS s FROM f)
    SELECT event_id, coalesce(CASE WHEN TRY_CAST(s.y AS INTEGER) BETWEEN 1980 AND 2100 THEN
       array_to_string(list_filter([s.y, s.m, s.d], lambda v: v <> ''), '-') END,
       nullif(regexp_extract(txt, '\b((?:19|20)\d{{2}})\b', 1), ''), strftime(ts, '%Y-%m-%d'), '') AS source_date FROM p""",
)
def _(t):
    e = F.col("event_id")
    fname = (
        F.when(e % 4 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-log.txt")))
        .when(e % 4 == 1, "x2019_07 log.txt").when(e % 4 == 2, "1850-log.txt").otherwise("log.txt")
    )
    text = F.when(e % 3 == 0, "released (2017) as x1999").otherwise(
        F.concat(F.col("event_type"), F.lit(" id "), e.cast("string"))
    )
    return t.events.select("event_id", T.source_date(fname, text, F.col("ts")).alias("source_date"))


@query("T10_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", T.content_hash(F.encode("text", "UTF-8")).alias("hash"))


@query("T11_embed_key", f"SELECT doc_id, sha1({S.squeeze('lower(' + S.trim('text') + ')')}) AS key FROM documents")
def _(t):
    return t.documents.select("doc_id", T.embed_key(F.col("text")).alias("key"))


@query("T12_type_home", f"SELECT source, pos, {S.type_home('type')} AS home FROM mentions", "mentions")
def _(t):
    return t.mentions.select("source", "pos", T.type_home(F.col("type")).alias("home"))


_REPLY = "CASE doc_id % 3 WHEN 0 THEN '<think>' || text || '</think> done ' || doc_id WHEN 1 THEN text || '<think>' || text ELSE ' <think>a</think>x<think>b</think> ' || text END"


@query(
    "T15_strip_thinking",
    rf"""SELECT doc_id, {S.trim(rf"regexp_replace(regexp_replace({_REPLY}, '<think>[\s\S]*?</think>', '', 'g'), '<think>[\s\S]*$', '')")} AS reply FROM documents""",
)
def _(t):
    d, x = F.col("doc_id"), F.col("text")
    reply = (
        F.when(d % 3 == 0, F.concat(F.lit("<think>"), x, F.lit("</think> done "), d.cast("string")))
        .when(d % 3 == 1, F.concat(x, F.lit("<think>"), x))
        .otherwise(F.concat(F.lit(" <think>a</think>x<think>b</think> "), x))
    )
    return t.documents.select("doc_id", T.strip_thinking(reply).alias("reply"))


# --- predicates --------------------------------------------------------------------------------


@query("F1_by_kind", "SELECT subdir, name FROM wiki WHERE subdir = 'concepts'", "wiki")
def _(t):
    return t.wiki.filter(F.col("subdir") == "concepts").select("subdir", "name")


@query(
    "F2_name_or_tag",
    f"""SELECT subdir, name FROM (SELECT subdir, name, array_to_string({S.list_items(S.field('tags'))}, ' ') AS tags FROM wiki)
    WHERE contains(lower(name), 'tool') OR contains(lower(tags), 'tool')""",
    "wiki",
)
def _(t):
    from foliograph.plans.browse import filter_pages, page_listing

    return filter_pages(page_listing(t.wiki), "Tool").select("subdir", "name")


@query("F3_node_search", "SELECT name FROM uniq WHERE contains(lower(name), 'et 1')", "wiki uniq")
def _(t):
    from foliograph.operators.graph import unique_pages

    return unique_pages(t.wiki).filter(F.contains(F.lower("name"), F.lit("et 1"))).select("name")


def _generic_sql(d, n):
    x = S.trim(d)
    return f"({d} <> '' AND ({S.context_local(x, n)} OR (length({x}) <= 200 AND regexp_matches({x}, {S.q(K.GENERIC_REFERENCE)}))))"


@query("F4_generic_description", f"SELECT source, pos, {_generic_sql('description', 'name')} AS hit FROM mentions", "mentions")
def _(t):
    return t.mentions.select("source", "pos", T.is_generic(F.col("description"), F.col("name")).alias("hit"))


@query("F4_generic_document", f"SELECT doc_id, {_generic_sql('text', 'source')} AS hit FROM documents")
def _(t):
    return t.documents.select("doc_id", T.is_generic(F.col("text"), F.col("source")).alias("hit"))


@query("F5_context_local", f"SELECT source, pos, {S.context_local('description', 'name')} AS hit FROM mentions", "mentions")
def _(t):
    return t.mentions.select("source", "pos", T.is_context_local(F.col("description"), F.col("name")).alias("hit"))


@query("F6_thin_description", f"SELECT source, pos, length({S.trim('description')}) < 30 AS hit FROM mentions", "mentions")
def _(t):
    return t.mentions.select("source", "pos", T.is_thin(F.col("description")).alias("hit"))


@query(
    "F7_type_compatible",
    f"SELECT pos, {S.compatible('type', 'tag')} AS hit FROM (SELECT pos, type, CASE pos % 5 WHEN 0 THEN '' WHEN 1 THEN 'App' WHEN 2 THEN 'technique' WHEN 3 THEN 'corpus' ELSE 'metric' END AS tag FROM mentions)",
    "mentions",
)
def _(t):
    p = F.col("pos") % 5
    other = F.when(p == 0, "").when(p == 1, "App").when(p == 2, "technique").when(p == 3, "corpus").otherwise("metric")
    return t.mentions.select("pos", T.types_compatible(F.col("type"), other).alias("hit"))


@query(
    "F8_registry_type",
    f"""SELECT m.pos, r.canonical_name, (lower({S.trim('m.type')}) = '' OR list_contains(string_split(r.compatible, ','), lower({S.trim('m.type')}))) AS hit
    FROM mentions m JOIN registry r ON {S.alias_key('m.name')} = {S.alias_key('r.canonical_name')}""",
    "mentions registry",
)
def _(t):
    m = t.mentions.withColumn("key", T.alias_key(F.col("name")))
    r = t.registry.withColumn("key", T.alias_key(F.col("canonical_name")))
    return m.join(r, "key").select(
        "pos", "canonical_name", T.accepts_type(F.split("compatible", ","), F.col("type")).alias("hit")
    )


@query("F11_thin_document", f"SELECT doc_id FROM documents WHERE length({S.trim('text')}) < 80")
def _(t):
    from foliograph.operators.lint import is_thin_page

    return t.documents.filter(is_thin_page(F.col("text"))).select("doc_id")


@query("F13_noise_gate", "SELECT rank, 1.0 / (60 + rank) < 0.005 AS noise FROM (SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank FROM documents)")
def _(t):
    from foliograph.operators.chat import is_noise

    ranked = t.documents.select((F.col("doc_id") + 1).cast("int").alias("rank"))
    return ranked.select("rank", is_noise(1.0 / (K.RRF_K + F.col("rank"))).alias("noise"))


@query("F15_valid_name", f"SELECT page_id, ({S.trim('n')} <> '' AND NOT regexp_matches(n, '\\.\\.|/|\\\\')) AS ok FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN ' ' WHEN 2 THEN 'a..b' ELSE 'page ' || page_id END AS n FROM pages)")
def _(t):
    p = F.col("page_id") % 4
    name = F.when(p == 0, F.col("url")).when(p == 1, " ").when(p == 2, "a..b").otherwise(
        F.concat(F.lit("page "), F.col("page_id").cast("string"))
    )
    return t.web_pages.select("page_id", T.is_valid_page_name(name).alias("ok"))
