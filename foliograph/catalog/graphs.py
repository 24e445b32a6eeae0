"""Registered queries: link graph, page browsing, lint and file administration."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.catalog import sql as S
from foliograph.catalog.registry import query
from foliograph.operators import files, graph, index, lint
from foliograph.plans import browse
from foliograph.functions import text as T

# --- scans and browsing ----------------------------------------------------------------------


@query("S2_unique_pages", "SELECT subdir, name, content FROM uniq", "wiki uniq")
def _(t):
    return graph.unique_pages(t.wiki)


@query(
    "S3_page_listing",
    f"""SELECT subdir, name, {S.field('type')} AS page_type, array_to_string({S.list_items(S.field('tags'))}, '|') AS tags,
    {S.field('created')} AS created, {S.field('updated')} AS updated FROM wiki""",
    "wiki",
)
def _(t):
    return browse.page_listing(t.wiki).withColumn("tags", F.array_join("tags", "|"))


@query(
    "S4_single_page",
    f"""SELECT name, subdir, content, {S.field('type')} AS page_type, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '{S.LINK}', 1))), '|') AS links
    FROM wiki WHERE subdir = 'entities' AND lower(name) = 'supplier#000000011' ORDER BY name = 'SUPPLIER#000000011' DESC, name LIMIT 1""",
    "wiki",
)
def _(t):
    page = browse.get_page(t.wiki, "entities", "SUPPLIER#000000011")
    return page.select("name", "subdir", "content", "page_type", F.array_join("outbound_links", "|").alias("links"))


# --- joins on the graph -----------------------------------------------------------------------


@query(
    "J1_resolved_links",
    "SELECT l.subdir, l.src, l.link_text, k.dst FROM links l LEFT JOIN keys k ON lower(l.link_text) = k.k",
    "wiki occ links keys",
)
def _(t):
    w = t.wiki
    links = w.select("subdir", F.col("name").alias("src"), F.explode(graph.P.link_targets(F.col("content"))).alias("link_text"))
    return graph.resolve(links, w)


# Line items as a large link list: orders link to suppliers under two spellings.
_LI_TEXT = "CASE WHEN l_partkey % 2 = 0 THEN 'Supplier#' ELSE 'supplier#' END || lpad(CAST(l_suppkey AS VARCHAR), CASE WHEN l_linenumber = 7 THEN 8 ELSE 9 END, '0')"


def _line_links(t):
    width = F.when(F.col("l_linenumber") == 7, 8).otherwise(9)
    number = F.lpad(F.col("l_suppkey").cast("string"), width, F.lit("0"))
    prefix = F.when(F.col("l_partkey") % 2 == 0, "Supplier#").otherwise("supplier#")
    return t.lineitem.select(
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("src"), F.concat(prefix, number).alias("link_text")
    )


@query(
    "J1_line_link_counts",
    f"""SELECT l.link_text, s.s_name AS dst, count(*) AS n FROM (SELECT {_LI_TEXT} AS link_text FROM lineitem) l
    LEFT JOIN supplier s ON lower(l.link_text) = lower(s.s_name) GROUP BY ALL""",
)
def _(t):
    return graph.target_counts(_line_links(t), t.supplier.select(F.col("s_name").alias("name")))


@query("J2_broken_links", "SELECT DISTINCT u.link_text AS target, u.src AS page FROM ulinks u WHERE lower(u.link_text) NOT IN (SELECT k FROM keys)", "wiki uniq uocc ulinks keys")
def _(t):
    return graph.broken_links(graph.unique_pages(t.wiki))


@query(
    "J3_orphans",
    """SELECT DISTINCT name FROM wiki WHERE name NOT IN ('index', 'log') AND name NOT IN
    (SELECT k.dst FROM links l JOIN keys k ON lower(l.link_text) = k.k)""",
    "wiki occ links keys",
)
def _(t):
    return graph.orphans(t.wiki)


@query("J4_isolated", "SELECT subdir, name FROM wiki w WHERE NOT EXISTS (SELECT 1 FROM occ o WHERE o.subdir = w.subdir AND o.src = w.name)", "wiki occ")
def _(t):
    w = t.wiki
    return w.filter(F.size(graph.P.link_occurrences(F.col("content"))) == 0).select("subdir", "name")


@query(
    "J5_missing_from_index",
    """WITH one AS (SELECT DISTINCT unnest(regexp_extract_all(lower(line), '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS k FROM catalog)
    SELECT DISTINCT name FROM wiki WHERE lower(name) NOT IN (SELECT k FROM one)""",
    "wiki catalog",
)
def _(t):
    return lint.missing_from_catalog(t.wiki, t.catalog)


@query(
    "J6_stale_index",
    f"""SELECT DISTINCT link_text AS target FROM (SELECT unnest(regexp_extract_all(line, '{S.LINK}', 1)) AS link_text FROM catalog)
    WHERE lower(link_text) NOT IN (SELECT k FROM keys)""",
    "wiki catalog keys",
)
def _(t):
    return lint.stale_catalog_links(t.wiki, t.catalog)


@query(
    "J7_inbound_of_page",
    "SELECT DISTINCT src AS name FROM occ WHERE lower(link_text) = 'nation_3' AND lower(src) <> 'nation_3'", "wiki occ",
)
def _(t):
    return graph.inbound(t.wiki, "Nation_3")


@query(
    "J7_inbound_pairs",
    "SELECT DISTINCT k.dst AS name, l.src AS page FROM links l JOIN keys k ON lower(l.link_text) = k.k WHERE lower(k.dst) <> lower(l.src)",
    "wiki occ links keys",
)
def _(t):
    return graph.inbound_pairs(t.wiki)


@query("U5_neighbours", "SELECT a AS name, b AS neighbour FROM nbrs", "wiki uniq uocc ulinks keys edges nbrs")
def _(t):
    return graph.neighbours(graph.unique_pages(t.wiki))


@query(
    "I7_graph_nodes",
    """SELECT u.subdir, u.name, coalesce(e.n, 0) AS link_count, 4.0 + least(coalesce(e.n, 0) / 30.0, 1.0) * 16.0 AS radius
    FROM uniq u LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) e ON u.name = e.dst""",
    "wiki uniq uocc ulinks keys edges",
)
def _(t):
    return graph.graph_nodes(graph.unique_pages(t.wiki))


@query("I7_graph_edges", "SELECT src AS source, dst AS target FROM edges", "wiki uniq uocc ulinks keys edges")
def _(t):
    return graph.graph_edges(t.wiki)


# --- aggregates ---------------------------------------------------------------------------------


@query("A1_pages_per_kind", "SELECT d.s AS subdir, count(w.name) AS n FROM (SELECT unnest(['sources','entities','concepts','synthesis']) AS s) d LEFT JOIN wiki w ON w.subdir = d.s GROUP BY 1", "wiki")
def _(t):
    return lint.page_counts(t.wiki)


@query("A3_in_degree", "SELECT dst AS name, count(*) AS n FROM edges GROUP BY dst", "wiki uniq uocc ulinks keys edges")
def _(t):
    return graph.edges(graph.unique_pages(t.wiki)).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n"))


@query(
    "A4_link_stats",
    """SELECT (SELECT count(*) FROM wiki) AS total_pages, CAST(sum(n) AS BIGINT) AS total_wikilinks,
    CAST(sum(n) FILTER (lower(link_text) NOT IN (SELECT k FROM keys)) AS BIGINT) AS broken_links FROM counted""",
    "wiki occ counted keys",
)
def _(t):
    return browse.wiki_stats(t.wiki)


@query(
    "A4_href_stats",
    f"""WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link_text FROM pages)
    SELECT count(*) AS total_wikilinks, count(*) FILTER (lower(link_text) NOT IN (SELECT lower(url) FROM pages)) AS broken_links FROM l""",
)
def _(t):
    p = t.web_pages
    links = p.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link_text"))
    counted = graph.target_counts(links, p.select(F.col("url").alias("name")))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_wikilinks"),
        F.coalesce(F.sum(F.when(F.col("dst").isNull(), F.col("n"))), F.lit(0)).alias("broken_links"),
    )


@query(
    "A13_broken_targets",
    """SELECT link_text AS target, count(DISTINCT src) AS n_pages, min(src) AS first_page FROM ulinks
    WHERE lower(link_text) NOT IN (SELECT k FROM keys) GROUP BY 1""",
    "wiki uniq uocc ulinks keys",
)
def _(t):
    return lint.broken_targets(t.wiki)


@query(
    "A19_bounding_box",
    """SELECT min(x - r) AS min_x, max(x + r) AS max_x, min(y - r) AS min_y, max(y + r) AS max_y
    FROM (SELECT o_custkey * 1.0 AS x, o_orderkey * 0.5 AS y, 4.0 + least((o_orderkey % 90) / 30.0, 1.0) * 16.0 AS r FROM orders)""",
)
def _(t):
    return graph.bounding_box(
        t.orders.select(
            (F.col("o_custkey") * 1.0).alias("x"), (F.col("o_orderkey") * 0.5).alias("y"),
            T.node_radius(F.col("o_orderkey") % 90).alias("radius"),
        )
    )


@query(
    "T16_node_radius",
    "SELECT s_suppkey, 4.0 + least(n / 30.0, 1.0) * 16.0 AS radius FROM (SELECT l_suppkey AS s_suppkey, count(*) // 40 AS n FROM lineitem GROUP BY 1)",
)
def _(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.floor(F.count("*") / 40).alias("n"))
    return n.select("s_suppkey", T.node_radius(F.col("n")).alias("radius"))


@query(
    "J19_node_color",
    """SELECT name, CASE WHEN contains(lower(name), 'widget') OR contains(lower(name), 'gear') THEN 'red'
    WHEN contains(lower(name), 'supplier') THEN 'blue' ELSE 'grey' END AS color FROM uniq""",
    "wiki uniq",
)
def _(t):
    color = graph.node_color(F.col("name"), [("Widget GEAR", "red"), ("  ", "none"), ("supplier widget", "blue")], "grey")
    return graph.unique_pages(t.wiki).select("name", color.alias("color"))


# --- lint -----------------------------------------------------------------------------------------

_PROBLEMS = """CASE WHEN NOT starts_with(content, '---') THEN 'missing yaml frontmatter'
    WHEN instr(substr(content, 4), '---') = 0 THEN 'unclosed yaml frontmatter'
    ELSE array_to_string(list_transform(list_filter(['type','created','tags','sources'],
      lambda f: NOT contains(left(substr(content, 4), instr(substr(content, 4), '---') - 1), f)), lambda f: 'missing ''' || f || ''''), ', ') END"""
_AFTER = """CASE WHEN starts_with(content, '---') AND instr(substr(content, 4), '---') > 0
    THEN substr(content, 4 + instr(substr(content, 4), '---') + 2) ELSE content END"""


@query("F10_frontmatter_issues", f"SELECT name, p AS problems FROM (SELECT name, {_PROBLEMS} AS p FROM uniq) WHERE p <> ''", "wiki uniq")
def _(t):
    return lint.frontmatter_issues(t.wiki)


@query("F11_thin_pages", f"SELECT name FROM uniq WHERE length({S.trim('(' + _AFTER + ')')}) < 80", "wiki uniq")
def _(t):
    return lint.thin_pages(t.wiki)


_FOLD_SQL = rf"""cut AS (SELECT subdir, name, {_AFTER} AS t FROM uniq),
    ln AS (SELECT subdir, name, list_filter(list_transform(string_split(t, chr(10)), lambda l: {S.trim('l')}), lambda l: l <> '') AS ls FROM cut),
    fold AS (SELECT subdir, name, ls, 0 AS i, '' AS acc, false AS bp FROM ln
        UNION ALL
        SELECT subdir, name, ls, i + 1,
          CASE WHEN starts_with(s, '# ') AND acc = '' THEN acc WHEN {S.in_list('s', K.BOILERPLATE_HEADINGS)} THEN acc
               WHEN bp AND starts_with(s, '- [[') THEN acc WHEN acc = '' THEN s ELSE acc || chr(10) || s END,
          CASE WHEN starts_with(s, '# ') AND acc = '' THEN bp WHEN {S.in_list('s', K.BOILERPLATE_HEADINGS)} THEN true
               WHEN bp AND starts_with(s, '- [[') THEN true ELSE false END
        FROM (SELECT *, ls[i + 1] AS s FROM fold WHERE i < len(ls)))"""
_BODYLESS_SQL = rf"""SELECT subdir, name FROM fold WHERE i = len(ls) AND CASE subdir WHEN 'sources'
      THEN length({S.trim("regexp_replace(acc, '(?m)^##[ ]+[A-Za-z0-9_][^" + chr(92) + "n]*$', '', 'g')")}) < 20
      WHEN 'synthesis' THEN false ELSE acc = '' END"""


@query("F12_bodyless", f"WITH RECURSIVE {_FOLD_SQL} {_BODYLESS_SQL}", "wiki uniq")
def _(t):
    return lint.bodyless_pages(t.wiki)


_REPORT_SQL = f"""{_FOLD_SQL},
broken AS (SELECT DISTINCT 'error' AS level, 'broken_link' AS code, u.src AS page, u.link_text AS target, '' AS detail FROM ulinks u WHERE lower(u.link_text) NOT IN (SELECT k FROM keys)),
stale AS (SELECT DISTINCT 'error', 'stale_index', 'index', link_text, '' FROM (SELECT unnest(regexp_extract_all(line, '{S.LINK}', 1)) AS link_text FROM catalog) WHERE lower(link_text) NOT IN (SELECT k FROM keys)),
orphan AS (SELECT 'warning', 'orphan', name, '', '' FROM uniq WHERE name NOT IN (SELECT k.dst FROM ulinks l JOIN keys k ON lower(l.link_text) = k.k)),
unlisted AS (SELECT 'warning', 'not_in_index', name, '', '' FROM uniq WHERE lower(name) NOT IN (SELECT unnest(regexp_extract_all(lower(line), '\\[\\[([^\\[\\]]+)\\]\\]', 1)) FROM catalog)),
fmi AS (SELECT 'warning', 'frontmatter', name, '', p FROM (SELECT name, {_PROBLEMS} AS p FROM uniq) WHERE p <> ''),
iso AS (SELECT 'info', 'isolated', name, '', '' FROM uniq WHERE name NOT IN (SELECT src FROM ulinks)),
thin AS (SELECT 'info', 'thin', name, '', '' FROM uniq WHERE length({S.trim('(' + _AFTER + ')')}) < 80),
found AS (SELECT * FROM broken UNION ALL SELECT * FROM stale UNION ALL SELECT * FROM orphan UNION ALL SELECT * FROM unlisted
  UNION ALL SELECT * FROM fmi UNION ALL SELECT * FROM iso UNION ALL SELECT * FROM thin
  UNION ALL SELECT 'warning', 'bodyless', name, '', '' FROM ({_BODYLESS_SQL}))
"""


@query("I6_lint_report", f"WITH RECURSIVE {_REPORT_SQL} SELECT * FROM found", "wiki catalog uniq uocc ulinks keys")
def _(t):
    return lint.report(t.wiki, t.catalog)


@query("I6_lint_summary", f"WITH RECURSIVE {_REPORT_SQL} SELECT level, code, count(*) AS n FROM found GROUP BY ALL", "wiki catalog uniq uocc ulinks keys")
def _(t):
    return lint.summary(lint.report(t.wiki, t.catalog))


# --- index build, files, administration -------------------------------------------------------------


@query(
    "K3_index_counts",
    """SELECT (SELECT count(*) FROM uniq) AS pages, (SELECT count(*) FROM wiki) AS page_files,
    (SELECT count(DISTINCT regexp_extract(content, '`raw/([^`]+)`', 1)) FROM wiki WHERE subdir = 'sources' AND contains(content, '`raw/')) AS source_files""",
    "wiki uniq",
)
def _(t):
    w = t.wiki
    counts = [
        graph.unique_pages(w).agg(F.count("*").alias("pages")),
        w.agg(F.count("*").alias("page_files")),
        index.raw_file_index(w).agg(F.count("*").alias("source_files")),
    ]
    return counts[0].select(
        "pages", counts[1].select("page_files").scalar().alias("page_files"),
        counts[2].select("source_files").scalar().alias("source_files"),
    )


_RAW = """raw AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'new-' ELSE 'order-' END || o_orderkey || '.txt' AS filename,
  sha256('order ' || CASE WHEN o_orderkey % 6 = 0 THEN '*' ELSE '' END || o_orderkey) AS hash, length(o_orderpriority) * o_orderkey AS size_bytes FROM orders),
marks AS (SELECT regexp_extract(content, '`raw/([^`]+)`', 1) AS filename, name AS source_page,
  regexp_extract(content, '(?m)^source_hash:\\s*([a-f0-9]{64})\\s*$', 1) AS stored FROM wiki WHERE subdir = 'sources' AND contains(content, '`raw/')),
stat AS (SELECT r.filename, r.size_bytes, m.source_page, CASE WHEN m.source_page IS NULL THEN 'pending'
  WHEN m.stored <> '' AND m.stored <> r.hash THEN 'changed' ELSE 'ingested' END AS status FROM raw r LEFT JOIN marks m USING (filename))"""


def _raw(t):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 10 == 0, "new-").otherwise("order-"), k.cast("string"), F.lit(".txt"))
    body = F.concat(F.lit("order "), F.when(k % 6 == 0, "*").otherwise(""), k.cast("string"))
    return t.orders.select(
        name.alias("filename"), T.content_hash(F.encode(body, "UTF-8")).alias("sha256"),
        (F.length("o_orderpriority") * k).alias("size_bytes"),
    )


@query("J8_file_status", f"WITH {_RAW} SELECT filename, size_bytes, status FROM stat", "wiki")
def _(t):
    return files.file_status(_raw(t), index.raw_file_index(t.wiki)).select("filename", "size_bytes", "status")


@query("J9_source_of_file", f"WITH {_RAW} SELECT filename, source_page FROM stat WHERE filename = 'order-77.txt'", "wiki")
def _(t):
    wanted = _raw(t).filter(F.col("filename") == "order-77.txt")
    return files.file_status(wanted, index.raw_file_index(t.wiki)).select("filename", "source_page")


@query("A2_file_counts", f"WITH {_RAW} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'changed') AS changed FROM stat", "wiki")
def _(t):
    return files.status_counts(files.file_status(_raw(t), index.raw_file_index(t.wiki)))


@query("F9_pending_or_changed", f"WITH {_RAW} SELECT filename, status FROM stat WHERE status IN ('pending', 'changed')", "wiki")
def _(t):
    return files.to_ingest(files.file_status(_raw(t), index.raw_file_index(t.wiki))).select("filename", "status")


@query("U4_unseen_files", f"WITH {_RAW} SELECT filename FROM raw WHERE filename NOT IN (SELECT filename FROM marks)", "wiki")
def _(t):
    return files.unseen(_raw(t), index.raw_file_index(t.wiki)).select("filename")


@query(
    "J10_stale_index_fallback",
    f"""WITH {_RAW}, old AS (SELECT filename, CASE WHEN length(filename) % 2 = 0 THEN 'Gone ' || filename ELSE source_page END AS source_page FROM marks)
    SELECT r.filename, CASE WHEN o.source_page IN (SELECT name FROM wiki WHERE subdir = 'sources') THEN o.source_page ELSE m.source_page END AS source_page
    FROM raw r LEFT JOIN old o USING (filename) LEFT JOIN marks m USING (filename)""",
    "wiki",
)
def _(t):
    w = t.wiki
    stored = index.raw_file_index(w)
    gone = F.when(F.length("filename") % 2 == 0, F.concat(F.lit("Gone "), F.col("filename"))).otherwise(F.col("source_page"))
    return files.locate_source_pages(_raw(t), stored.withColumn("source_page", gone), w)


@query(
    "S11_upload_gate",
    """SELECT page_id, CASE WHEN ok THEN b END AS stored_as, ok AND size <= 52428800 AS accepted FROM (
      SELECT *, b <> '' AND NOT starts_with(b, '.') AND regexp_matches(lower(b), '.[.](md|txt|pdf|xml|html|htm|rtf|csv|json|rst)$') AS ok FROM (
        SELECT page_id, trim(regexp_extract(n, '([^/]*)/*$', 1)) AS b, size FROM (SELECT page_id, length(html) * (page_id % 40) * 2000 AS size,
          CASE page_id % 5 WHEN 0 THEN 'dir/page ' || page_id || '.HTML' WHEN 1 THEN '.env' WHEN 2 THEN 'x.exe' WHEN 3 THEN '../up-' || page_id || '.md' ELSE ' notes.txt ' END AS n FROM pages)))""",
)
def _(t):
    p = F.col("page_id")
    name = (
        F.when(p % 5 == 0, F.concat(F.lit("dir/page "), p.cast("string"), F.lit(".HTML")))
        .when(p % 5 == 1, ".env").when(p % 5 == 2, "x.exe")
        .when(p % 5 == 3, F.concat(F.lit("../up-"), p.cast("string"), F.lit(".md"))).otherwise(" notes.txt ")
    )
    uploads = t.web_pages.select("page_id", name.alias("filename"), (F.length("html") * (p % 40) * 2000).alias("size_bytes"))
    return files.upload_gate(uploads).select("page_id", "stored_as", "accepted")


@query(
    "K9_reset_preview",
    "SELECT subdir AS area, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM wiki GROUP BY 1 UNION ALL SELECT 'raw', count(*), CAST(sum(length(o_orderpriority) * o_orderkey) AS BIGINT) FROM orders",
    "wiki",
)
def _(t):
    return browse.reset_preview(t.wiki, _raw(t))


@query("A17_totals", "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(t):
    return files.totals(t.documents, ["source"], F.col("text")).select("source", F.col("n").alias("files"), "bytes")


@query(
    "K8_delete_pages",
    f"""WITH req AS (SELECT 'entities' AS subdir, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) ELSE '../' || s_name END AS name FROM supplier),
    gone AS (SELECT DISTINCT w.subdir, w.name FROM wiki w JOIN req r ON w.subdir = r.subdir AND lower(w.name) = lower(r.name))
    SELECT w.subdir, w.name FROM wiki w WHERE (w.subdir, w.name) NOT IN (SELECT subdir, name FROM gone)""",
    "wiki",
)
def _(t):
    return files.delete_pages(t.wiki, _delete_request(t)).select("subdir", "name")


def _delete_request(t):
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, F.col("s_name")).when(k == 1, F.upper("s_name")).otherwise(F.concat(F.lit("../"), F.col("s_name")))
    return t.supplier.select(F.lit("entities").alias("subdir"), name.alias("name"))


@query(
    "K8_catalog_cleanup",
    f"""WITH req AS (SELECT lower(s_name) AS k FROM supplier WHERE s_suppkey % 3 < 2),
    ln AS (SELECT section, line, regexp_extract_all(line, '{S.LINK}', 1) AS l FROM catalog)
    SELECT section, line FROM ln WHERE NOT list_has_any(list_transform(l, lambda x: lower(x)), (SELECT list(k) FROM req))""",
    "catalog",
)
def _(t):
    deleted = files.matched_deletions(t.wiki, _delete_request(t))
    return files.clean_catalog(t.catalog, deleted)


@query(
    "K4_catalog_upsert",
    f"""WITH listed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(line), '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS k FROM catalog),
    new AS (SELECT DISTINCT CASE subdir WHEN 'entities' THEN '## Entities' ELSE '## Concepts' END AS section, name, {S.description()} AS d FROM wiki WHERE subdir IN ('entities', 'concepts'))
    SELECT section, '- [[' || name || ']] — ' || {S.trim("replace(left(d, 120), chr(10), ' ')")} AS line FROM new WHERE lower(name) NOT IN (SELECT k FROM listed)""",
    "wiki catalog",
)
def _(t):
    w = t.wiki.filter(F.col("subdir").isin("entities", "concepts"))
    entries = w.select("subdir", "name", graph.P.description(F.col("content")).alias("description")).distinct()
    return files.catalog_additions(t.catalog, entries)
