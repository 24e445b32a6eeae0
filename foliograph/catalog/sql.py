"""ANSI SQL spellings of the shared expressions and relations, used only by the oracles."""

from __future__ import annotations

from foliograph import constants as K
from foliograph.sources.derived import ansi

LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{K.WS}+|{K.WS}+$', '', 'g')"


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '{K.WS}+$', '')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{K.WS}+', ' ', 'g')"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


def fm(x: str = "content") -> str:
    return rf"regexp_extract({x}, '^---\n([\s\S]*?)\n---\n', 1)"


def has_fm(x: str = "content") -> str:
    return rf"regexp_matches({x}, '^---\n([\s\S]*?)\n---\n')"


def raw_body(x: str = "content") -> str:
    return rf"regexp_replace({x}, '^---\n([\s\S]*?)\n---\n', '')"


def body(x: str = "content") -> str:
    return f"CASE WHEN {has_fm(x)} THEN {trim(raw_body(x))} ELSE {x} END"


def field(key: str, x: str = "content") -> str:
    """Value of the last front-matter line with the key."""
    lines = f"list_filter(string_split({fm(x)}, chr(10)), lambda l: contains(l, ':') AND {trim('regexp_extract(l, ' + q('^([^:]*):') + ', 1)')} = {q(key)})"
    return f"coalesce({trim('regexp_replace(' + lines + '[-1], ' + q('^[^:]*:') + ', ' + q('') + ')')}, '')"


def list_items(v: str) -> str:
    inner = f"substr({v}, 2, length({v}) - 2)"
    return (
        f"CASE WHEN starts_with({v}, '[') AND ends_with({v}, ']') THEN "
        f"list_transform(list_filter(string_split({inner}, ','), lambda v: {trim('v')} <> ''), "
        f"lambda v: trim({trim('v')}, '''\"')) ELSE []::VARCHAR[] END"
    )


def anchored(name: str, x: str = "content") -> str:
    inner = rf"regexp_extract({fm(x)}, '(?m)^{name}:[ \t]*\[([^\]]*)\][ \t]*$', 1)"
    return f"list_filter(list_transform(string_split({inner}, ','), lambda v: {trim('v')}), lambda v: v <> '')"


def first_tag(x: str = "content") -> str:
    tags = field("tags", x)
    return (
        rf"CASE WHEN regexp_matches({tags}, '\[[^\]]*\]') THEN "
        + trim(rf"string_split(regexp_extract({tags}, '\[([^\]]*)\]', 1), ',')[1]")
        + f" ELSE {field('type', x)} END"
    )


def first_paragraph(text: str) -> str:
    paras = rf"list_transform(regexp_split_to_array({text}, '\n\n+'), lambda p: {trim('p')})"
    return (
        f"coalesce(list_filter({paras}, lambda p: p <> '' AND NOT starts_with(p, '#') AND NOT starts_with(p, '>'))[1], '')"
    )


def description(x: str = "content") -> str:
    return first_paragraph(raw_body(x))


def stem(w: str) -> str:
    whens = " ".join(
        f"WHEN ends_with({w}, {q(s)}) AND length({w}) > {len(s) + 2} THEN left({w}, length({w}) - {len(s)})"
        for s in K.SUFFIXES
    )
    return f"CASE {whens} ELSE {w} END"


def stems(text: str) -> str:
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '[a-zA-Z]+')"
    kept = f"list_filter({found}, lambda w: length(w) >= 3 AND NOT ({in_list('w', K.STOP_WORDS)}))"
    return f"list_distinct(list_transform({kept}, lambda w: {stem('w')}))"


def jaccard(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / "
        f"(len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    )


def strip_parens(n: str) -> str:
    return rtrim(rf"regexp_replace({n}, '{K.WS}*(?:\([^)]+\){K.WS}*)+$', '')")


def dedup_key(n: str) -> str:
    base = f"lower(regexp_replace({trim(strip_parens(n))}, '[.,;:!? ]+$', ''))"
    parts = f"list_filter(regexp_split_to_array({base}, '{K.WS}+'), lambda w: w <> '')"
    once = f"list_transform({parts}, lambda w: {stem('w')})"
    twice = f"list_transform({once}, lambda w: {stem('w')})"
    return f"CASE WHEN {base} = '' THEN lower({n}) ELSE array_to_string({twice}, ' ') END"


def alias_key(n: str) -> str:
    bare = rf"regexp_replace(lower({trim(n)}), '{K.WS}*\([^)]*\){K.WS}*', ' ', 'g')"
    bare = rf"regexp_replace({bare}, '[^\p{{L}}\p{{N}}_\t\n\x0B\f\r\x1C-\x1F\x{{85}}\p{{Z}}-]', ' ', 'g')"
    return trim(squeeze(bare))


def safe_name(n: str) -> str:
    clean = rf"""regexp_replace({n}, '[<>:"/\\|?*\[\]\x00-\x1f]', '', 'g')"""
    clean = rf"regexp_replace({clean}, '\.\.', '', 'g')"
    clean = f"regexp_replace({trim(squeeze(clean))}, '[.,;:!? ]+$', '')"
    return f"CASE WHEN {clean} = '' THEN 'Untitled' WHEN length({clean}) > 120 THEN {trim(f'left({clean}, 120)')} ELSE {clean} END"


def fork_name(base: str, qualifier: str) -> str:
    return safe_name(f"({base} || ' (' || lower({trim(f'CASE WHEN {qualifier} = {q(str())} THEN {q(chr(97) + chr(108) + chr(116))} ELSE {qualifier} END')}) || ')')")


def year(d: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({d}, '(19|20)\d{{2}}'), '') AS INTEGER)"


def context_local(d: str, n: str) -> str:
    rx = "(?i)(?:" + "|".join(K.CONTEXT_LOCAL_PATTERNS) + ")"
    fill = "|".join(K.CONTEXT_LOCAL_FILLERS)
    return (
        f"({d} <> '' AND (regexp_matches({d}, {q(rx)}) OR ({n} <> '' AND length({d}) < 40 AND "
        f"contains(lower({d}), lower({n})) AND regexp_matches(lower({d}), {q(fill)}))))"
    )


def type_home(t: str) -> str:
    v = f"lower({trim(t)})"
    return f"CASE WHEN {in_list(v, K.CONCEPT_TYPES)} THEN 'concepts' WHEN {in_list(v, K.ENTITY_TYPES)} THEN 'entities' ELSE '' END"


def compatible(a: str, b: str) -> str:
    x, y = f"lower({trim(a)})", f"lower({trim(b)})"
    groups = " OR ".join(f"({in_list(x, g)} AND {in_list(y, g)})" for g in K.TYPE_GROUPS)
    return f"({a} = '' OR {b} = '' OR {x} = {y} OR {groups})"


def kind_order(x: str = "subdir") -> str:
    return f"list_position(['sources','entities','concepts','synthesis'], {x})"


CTES = {
    "wiki": ansi("wiki"),
    "catalog": ansi("catalog"),
    "registry": ansi("registry"),
    "mentions": ansi("mentions"),
    "items": ansi("items"),
    "questions": ansi("questions"),
    "uniq": f"SELECT subdir, name, content FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {kind_order()} DESC) AS rn FROM wiki) WHERE rn = 1",
    "occ": f"SELECT subdir, name AS src, unnest(regexp_extract_all(content, '{LINK}', 1)) AS link_text FROM wiki",
    "links": "SELECT DISTINCT subdir, src, link_text FROM occ",
    "uocc": f"SELECT subdir, name AS src, unnest(regexp_extract_all(content, '{LINK}', 1)) AS link_text FROM uniq",
    "ulinks": "SELECT DISTINCT src, link_text FROM uocc",
    "keys": "SELECT lower(name) AS k, max(name) AS dst FROM wiki GROUP BY 1",
    "counted": "SELECT link_text, count(*) AS n FROM occ GROUP BY 1",
    "edges": "SELECT u.src, k.dst, u.link_text FROM ulinks u JOIN keys k ON lower(u.link_text) = k.k WHERE k.dst <> u.src",
    "nbrs": "SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges",
}
_MATERIALIZED = {"wiki", "uniq", "occ", "uocc", "registry", "mentions", "items", "hits"}


def with_ctes(names: list[str], sql: str) -> str:
    if not names:
        return sql.strip()
    parts = [f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}(\n{CTES[n]}\n)" for n in names]
    body_sql = sql.strip()
    if body_sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body_sql[15:]
    if body_sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body_sql[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body_sql


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def _pairs(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def bm25_ctes(key: str, docs: str, queries: str) -> dict[str, str]:
    """Oracle relations of a BM25 run over docs(key, f_name, f_type, f_tags, f_content)."""
    cols = (("f_name", 10.0), ("f_type", 3.0), ("f_tags", 5.0), ("f_content", 1.0))
    tok = "\nUNION ALL ".join(
        f"SELECT {key}, {w} AS w, unnest({g}) AS term FROM toks" for c, w in cols for g in (c, _pairs(c))
    )
    return {
        "toks": f"SELECT {key}, {', '.join(f'{tokens(c)} AS {c}' for c, _ in cols)} FROM ({docs})",
        "lens": f"SELECT {key}, {' + '.join(f'len({c})' for c, _ in cols)} AS dl FROM toks",
        "stat": "SELECT count(*) AS n, avg(dl) AS avgdl FROM lens",
        "qw": rf"SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM ({queries})",
        "qt": rf"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, array_to_string(regexp_extract_all(word, '[\p{{L}}\p{{N}}]+'), ' ') AS term FROM qw) WHERE term <> '' GROUP BY ALL",
        "tok": tok,
        "post": f"SELECT {key}, term, sum(w) AS f FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL",
        "idf": "SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), stat",
        "scored": f"SELECT query_id, {key}, sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score "
        f"FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN lens USING ({key}), stat GROUP BY query_id, {key}",
    }


_WIKI_DOCS = (
    rf"SELECT subdir, name, name AS f_name, {trim(rf'''regexp_extract({fm()}, 'type:\s*([^\n]+)', 1)''')} AS f_type, "
    rf"{trim(rf'''regexp_extract({fm()}, 'tags:\s*\[([^\]]*)\]', 1)''')} AS f_tags, {body()} AS f_content FROM wiki"
)
CTES.update(bm25_ctes("subdir, name", _WIKI_DOCS, "SELECT * FROM questions"))
CTES.update({
    "hits": "SELECT * FROM (SELECT query_id, subdir, name, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, name, subdir) AS rank FROM scored) WHERE rank <= 40",
    "seeds": "SELECT query_id, name, count(*) AS times FROM hits WHERE rank <= 10 GROUP BY ALL",
    "near": "SELECT s.query_id, n.b AS name, sum(s.times) AS hits FROM seeds s JOIN nbrs n ON s.name = n.a WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = s.query_id AND x.name = n.b) GROUP BY ALL",
    "near_ranked": "SELECT query_id, name, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, name) AS rank FROM near",
    "fused": "SELECT query_id, name, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, name, rank FROM hits UNION ALL SELECT query_id, name, rank FROM near_ranked) GROUP BY ALL",
    "found": "SELECT * FROM (SELECT query_id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, name) AS rank FROM fused) WHERE rank <= 20",
    "loaded": "SELECT f.query_id, f.rank, f.name, u.subdir, u.content, row_number() OVER w AS place, sum(length(u.content)) OVER (w ROWS UNBOUNDED PRECEDING) AS chars FROM found f JOIN uniq u USING (name) WINDOW w AS (PARTITION BY f.query_id ORDER BY u.subdir <> 'sources', f.rank)",
})
_MATERIALIZED.update({"toks", "post", "scored", "hits", "found", "loaded", "near", "nbrs"})
BM25 = "wiki questions toks lens stat qw qt tok post idf scored"
SEARCH = BM25 + " hits uniq uocc ulinks keys edges nbrs seeds near near_ranked fused found"
