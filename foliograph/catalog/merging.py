"""Registered queries: duplicate clusters, merges and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.catalog import sql as S
from foliograph.catalog.registry import query
from foliograph.catalog.resolution import _entries
from foliograph.functions import rewrite as R
from foliograph.operators import dedup

_TAGS = "list_transform(" + S.anchored("tags") + ", lambda v: lower(v))"
S.CTES.update({
    "dinfo": f"SELECT subdir, name, length({S.description()}) AS desc_len, {_TAGS} AS tags, coalesce({_TAGS}[1], '') AS type FROM wiki WHERE subdir IN ('entities', 'concepts')",
    "dkeys": f"""SELECT d.*, p.canonical_name AS canon, CASE WHEN p.key IS NOT NULL THEN 'alias::' || p.key ELSE 'stem::' || {S.dedup_key('d.name')} END AS group_key
      FROM (SELECT *, {S.alias_key('name')} AS sk FROM dinfo) d LEFT JOIN aidx a ON a.key = d.sk LEFT JOIN prim p ON p.key = a.primary_key AND p.subdir = d.subdir
      AND (d.type = '' OR list_contains(string_split(p.compatible, ','), d.type))""",
    "dplan": f"""SELECT *, first_value(subdir) OVER w AS keep_subdir, first_value(name) OVER w AS keep_name FROM (
      SELECT *, count(*) OVER (PARTITION BY group_key) AS n, bool_or(is_canon) OVER (PARTITION BY group_key) AS any_canon, bool_or(routed) OVER (PARTITION BY group_key) AS any_routed FROM (
        SELECT *, coalesce(name = {S.safe_name('canon')}, false) AS is_canon,
          CASE subdir WHEN 'concepts' THEN list_has_any(tags, [{', '.join(S.q(x) for x in K.CONCEPT_TYPES)}])
            ELSE list_has_any(tags, [{', '.join(S.q(x) for x in K.ENTITY_TYPES)}]) AND NOT list_has_any(tags, [{', '.join(S.q(x) for x in K.CONCEPT_TYPES)}]) END AS routed FROM dkeys))
      WHERE n > 1 WINDOW w AS (PARTITION BY group_key ORDER BY CASE WHEN any_canon THEN NOT is_canon WHEN any_routed THEN NOT routed ELSE false END,
        contains(name, '('), length(name), desc_len DESC, subdir = 'concepts', name)""",
    "roles": "SELECT group_key, subdir, name, n, keep_subdir, keep_name, CASE WHEN subdir = keep_subdir AND name = keep_name THEN 'keep' ELSE 'merge' END AS role FROM dplan",
    "ren": "SELECT name AS old, max_by(keep_name, group_key || ' ' || (subdir = 'concepts')::INT || name) AS new FROM roles WHERE role = 'merge' GROUP BY name",
})
S._MATERIALIZED.update({"dkeys", "roles"})
PLAN = "wiki registry prim al aidx dinfo dkeys dplan roles"


@query("D1_cluster_keys", "SELECT subdir, name, group_key FROM dkeys", "wiki registry prim al aidx dinfo dkeys")
def _(t):
    return dedup.members(t.wiki, _entries(t)).select("subdir", "name", "group_key")


@query("D1_stem_keys", f"SELECT subdir, name, 'stem::' || {S.dedup_key('name')} AS group_key FROM dinfo", "wiki dinfo")
def _(t):
    return dedup.members(t.wiki).select("subdir", "name", "group_key")


@query("D2_clusters", "SELECT DISTINCT group_key, n FROM dplan", PLAN)
def _(t):
    return dedup.survivors(dedup.members(t.wiki, _entries(t))).select("group_key", "n")


@query("D3_survivors", "SELECT DISTINCT group_key, keep_subdir, keep_name, n FROM dplan", PLAN)
def _(t):
    return dedup.survivors(dedup.members(t.wiki, _entries(t)))


@query("D9_merge_plan", "SELECT * FROM roles", PLAN)
def _(t):
    return dedup.plan(t.wiki, _entries(t))


@query("A16_plan_totals", "SELECT count(*) FILTER (role = 'keep') AS groups, count(*) FILTER (role = 'merge') AS merged FROM roles", PLAN)
def _(t):
    return dedup.plan_totals(dedup.plan(t.wiki, _entries(t)))


_LISTS = " UNION ALL ".join(
    f"SELECT subdir, name, '{f}' AS field, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM (SELECT subdir, name, {S.anchored(f)} AS l FROM wiki)"
    for f in ("sources", "source_dates", "tags")
)
_MERGED = f"""lists AS ({_LISTS}),
merged AS (SELECT group_key, field, item, row_number() OVER (PARTITION BY group_key, field ORDER BY loser, kind, name, pos) AS ord FROM (
  SELECT r.group_key, l.field, l.item, r.role = 'merge' AS loser, r.subdir = 'concepts' AS kind, r.name, l.pos,
    row_number() OVER (PARTITION BY r.group_key, l.field, lower(l.item) ORDER BY r.role = 'merge', r.subdir = 'concepts', r.name, l.pos) AS rn
  FROM roles r JOIN lists l USING (subdir, name)) WHERE rn = 1)"""


@query("A9_merged_lists", f"WITH {_MERGED} SELECT group_key, field, item FROM merged", PLAN)
def _(t):
    return dedup.merged_lists(t.wiki, dedup.plan(t.wiki, _entries(t))).select("group_key", "field", "item")


@query(
    "D4_merged_metadata",
    f"WITH {_MERGED} SELECT group_key, field, string_agg(item, ', ' ORDER BY ord) AS items FROM merged GROUP BY ALL", PLAN,
)
def _(t):
    merged = dedup.merged_lists(t.wiki, dedup.plan(t.wiki, _entries(t)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda r: r["item"])
    return merged.groupBy("group_key", "field").agg(F.array_join(ordered, ", ").alias("items"))


@query("D8_rename_map", "SELECT old, new FROM ren", PLAN + " ren")
def _(t):
    return dedup.rename_map(dedup.plan(t.wiki, _entries(t)))


@query(
    "D8_rewritten_pages",
    "SELECT DISTINCT subdir, name FROM (SELECT subdir, name, unnest(regexp_extract_all(content, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS tok FROM wiki) JOIN ren ON tok = old WHERE old <> new",
    PLAN + " ren",
)
def _(t):
    return dedup.rewritten_pages(t.wiki, dedup.rename_map(dedup.plan(t.wiki, _entries(t))))


@query(
    "D8_rewritten_text",
    """WITH pieces AS (SELECT subdir, name, i, CASE WHEN i = 1 THEN p ELSE coalesce(r.new || substr(p, length(r.old) + 1), p) END AS p FROM (
        SELECT subdir, name, unnest(string_split(content, '[[')) AS p, generate_subscripts(string_split(content, '[['), 1) AS i FROM wiki) x
      LEFT JOIN ren r ON i > 1 AND r.old = regexp_extract(x.p, '^([^\\[\\]]+)\\]\\]', 1))
    SELECT subdir, name, string_agg(p, '[[' ORDER BY i) AS content FROM pieces GROUP BY ALL""",
    PLAN + " ren",
)
def _(t):
    w = t.wiki
    return dedup.rewrite_links(w, dedup.rename_map(dedup.plan(w, _entries(t))))


@query("D9_applied_wiki")
def _(t):
    w = t.wiki
    return dedup.apply(w, dedup.plan(w, _entries(t)))


@query(
    "D9_applied_pages",
    "SELECT subdir, name FROM wiki EXCEPT SELECT subdir, name FROM roles WHERE role = 'merge'", PLAN,
)
def _(t):
    w = t.wiki
    return dedup.apply(w, dedup.plan(w, _entries(t))).select("subdir", "name")


@query(
    "D5_rewritten_lists",
    rf"""WITH m AS (SELECT subdir, name, {S.anchored('sources')} AS sources, {S.anchored('tags')} AS tags, content FROM wiki)
    SELECT subdir, name, CASE WHEN NOT contains(substr(content, 4), chr(10) || '---') THEN content ELSE regexp_replace(regexp_replace(content, 'tags: [^\n]*', 'tags: [' || array_to_string(list_reverse(tags), ', ') || ', merged]'),
      'sources: [^\n]*', 'sources: [' || array_to_string(list_reverse(sources), ', ') || ']' || CASE WHEN contains(content, chr(10) || 'source_dates:') THEN '' ELSE chr(10) || 'source_dates: [2001]' END) END AS content
    FROM (SELECT subdir, name, sources, tags, CASE WHEN contains(content, chr(10) || 'source_dates:') THEN regexp_replace(content, 'source_dates: [^\n]*', 'source_dates: [2001]') ELSE content END AS content FROM m)""",
    "wiki",
)
def _(t):
    from foliograph.functions import pages as P

    c = F.col("content")
    text = R.replace_list_fields(
        c, F.reverse(P.anchored_list(c, "sources")), F.array(F.lit("2001")),
        F.concat(F.reverse(P.anchored_list(c, "tags")), F.array(F.lit("merged"))),
    )
    return t.wiki.select("subdir", "name", text.alias("content"))


@query(
    "D6_stripped_callouts",
    r"""SELECT subdir, name, CASE WHEN t = 'widget ' || block THEN regexp_replace(content, '(?m)^> [*][*]Disambiguation:[*][*] see also [^\n]*\n\n', '') ELSE content END AS content
    FROM (SELECT subdir, name, content, regexp_extract(name, '(\d+)', 1) AS block, lower(regexp_extract(content, 'Disambiguation:[*][*] see also \[\[(.+?)\]\]', 1)) AS t FROM wiki)""",
    "wiki",
)
def _(t):
    block = F.regexp_extract("name", r"(\d+)", 1)
    stale = F.array_intersect(R.callout_targets(F.col("content")), F.array(F.concat(F.lit("widget "), block)))
    return t.wiki.select("subdir", "name", R.strip_callouts(F.col("content"), stale).alias("content"))


@query(
    "D7_appended_mentions",
    """SELECT subdir, name, CASE WHEN loc = 0 OR len(fresh) = 0 THEN content ELSE left(content, loc - 1) || '## Mentioned In' || chr(10) || chr(10) ||
        array_to_string(list_concat(list_filter(string_split(tail, chr(10)), lambda l: trim(l) <> ''), list_transform(fresh, lambda s: '- [[' || s || ']]')), chr(10)) || chr(10) END AS content
    FROM (SELECT *, list_filter(['Extra', 'order 8'], lambda s: NOT list_contains(list_transform(regexp_extract_all(tail, '\\[\\[(.+?)\\]\\]', 1), lambda x: lower(x)), lower(s))) AS fresh
      FROM (SELECT subdir, name, content, instr(content, '## Mentioned In') AS loc, substr(content, instr(content, '## Mentioned In') + 15) AS tail FROM wiki))""",
    "wiki",
)
def _(t):
    added = F.array(F.lit("Extra"), F.lit("order 8"))
    return t.wiki.select("subdir", "name", R.append_mentions(F.col("content"), added).alias("content"))


@query(
    "D12_callouts",
    r"""SELECT subdir, name, CASE WHEN contains(content, '[[' || sib || ']]') THEN content WHEN fm = '' THEN CASE WHEN regexp_matches(content, '(?m)^#[^\n]*\n') THEN regexp_replace(content, '(?m)^(#[^\n]*\n)', '\1' || chr(10) || note) ELSE note || content END
        WHEN regexp_matches(b, '(?m)^#[^\n]*\n') THEN fm || regexp_replace(b, '(?m)^(#[^\n]*\n)', '\1' || chr(10) || note) ELSE fm || note || b END AS content
    FROM (SELECT *, '> **Disambiguation:** see also [[' || sib || ']] — distinct entry that shares this name.' || chr(10) || chr(10) AS note FROM (
      SELECT subdir, name, content, 'NATION_' || (length(content) % 25) AS sib, regexp_extract(content, '^---\n[\s\S]*?\n---\n') AS fm, regexp_replace(content, '^---\n[\s\S]*?\n---\n', '') AS b FROM wiki))""",
    "wiki",
)
def _(t):
    sibling = F.concat(F.lit("NATION_"), (F.length("content") % 25).cast("string"))
    return t.wiki.select("subdir", "name", R.add_callout(F.col("content"), sibling).alias("content"))


_SELECT = "sel AS (SELECT s_name AS canonical, s_suppkey AS pos, 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name FROM supplier)"


@query(
    "D10_selected_merges",
    rf"""WITH {_SELECT}, body AS (SELECT name, {S.body()} AS b FROM wiki WHERE subdir = 'entities'),
    parts AS (SELECT s.*, {S.trim('b.b')} AS b FROM sel s JOIN body b USING (name) WHERE s.canonical IN (SELECT name FROM body)),
    rest AS (SELECT w.subdir, w.name, w.content || coalesce(chr(10) || chr(10) || '---' || chr(10) || '> *Merged from ' || p.name || '*' || chr(10) || chr(10) || p.b, '') AS content
      FROM wiki w LEFT JOIN parts p ON w.subdir = 'entities' AND p.canonical = w.name WHERE NOT (w.subdir = 'entities' AND w.name IN (SELECT name FROM parts))),
    pieces AS (SELECT subdir, x.name, i, CASE WHEN i = 1 THEN p ELSE coalesce(r.canonical || substr(p, length(r.name) + 1), p) END AS p FROM (
        SELECT subdir, name, unnest(string_split(content, '[[')) AS p, generate_subscripts(string_split(content, '[['), 1) AS i FROM rest) x
      LEFT JOIN parts r ON i > 1 AND r.name = regexp_extract(x.p, '^([^\[\]]+)\]\]', 1))
    SELECT subdir, name, string_agg(p, '[[' ORDER BY i) AS content FROM pieces GROUP BY ALL""",
    "wiki",
)
def _(t):
    number = F.lpad(F.col("s_suppkey").cast("string"), 9, F.lit("0"))
    selection = t.supplier.select(
        F.col("s_name").alias("canonical"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("Customer#"), number).alias("name")
    )
    return dedup.apply_selected(t.wiki, selection)
