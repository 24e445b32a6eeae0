"""A linked wiki, a gazetteer and extracted items derived row by row from the star-schema tables.

The shipped tables hold no ``[[links]]``, so the operators that need a wiki read this one. It is
plain string SQL over whole tables (one page per row, no aggregation), written so that Spark and
any ANSI engine build the same relation: ``{orders}`` and so on name the input tables, ``{hash}``
the engine's spelling of a SHA-256 digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from foliograph.session import SPLIT_BYTES, grow_shuffles, spread, stored_bytes

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_NL = "chr(10)"


def _lines(*parts: str) -> str:
    return f" || {_NL} || ".join(parts)


def _widget(block: str, variant: str, kind: str) -> str:
    """Four spellings of one widget name."""
    return (
        f"CASE {variant} WHEN 0 THEN 'Widget ' || {block} WHEN 1 THEN 'Widgets ' || {block} "
        f"WHEN 2 THEN 'Widget ' || {block} || ' (' || {kind} || ')' ELSE 'WIDGET ' || {block} || '.' END"
    )


_KIND = (
    "CASE p_type WHEN 'ECONOMY' THEN 'tool' WHEN 'LARGE' THEN 'model' WHEN 'PROMO' THEN 'method' "
    "WHEN 'MEDIUM' THEN 'metric' WHEN 'STANDARD' THEN 'dataset' ELSE 'person' END"
)

_ORDER_PAGE = _lines(
    "'---'",
    "'type: source'",
    "'tags: [' || lower(o_orderpriority) || ', order]'",
    "'sources: [raw/order-' || o_orderkey || '.txt]'",
    "'source_date: ' || CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'source_hash: ' || {hash} ELSE 'note: unhashed' END",
    "CASE WHEN o_orderkey % 9 = 0 THEN 'updated: ' ELSE 'created: ' END || CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "'---'",
    "''",
    "'# Order ' || o_orderkey",
    "''",
    "'**Source:** `raw/order-' || o_orderkey || '.txt`'",
    "''",
    "'## Summary'",
    "''",
    "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Order ' || o_orderkey || ' of status ' || o_orderstatus || "
    "' was placed by [[Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') || ']] with priority ' || o_orderpriority || '.' END",
    "''",
    "'## Entities Mentioned'",
    "''",
    "'- [[widget ' || o_custkey || '|a widget]] and [[Widgets ' || o_custkey || ']]'",
    "'- [[Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') || ']]'",
    "''",
)

_SUPPLIER_PAGE = _lines(
    "'---'",
    "'type: entity'",
    "'tags: [organization, supplier]'",
    "'sources: [Order ' || s_suppkey || ', Order ' || (s_suppkey + 1) || ', Order ' || (s_suppkey + 2) || ']'",
    "CASE WHEN s_suppkey % 5 = 0 THEN 'updated: 1999-01-01' ELSE 'created: 1999-01-01' END",
    "'---'",
    "''",
    "'# ' || s_name",
    "''",
    "CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE "
    "'A supplier in ' || CASE WHEN s_suppkey % 2 = 1 THEN '[[nation_' ELSE '[[NATION_' END || s_nationkey || ']] "
    "that ships parts e.g. rings and bolts. It also sells gears.' END",
    "CASE WHEN s_suppkey % 7 = 0 THEN 'See [[ghost-' || (s_suppkey % 5) || ']].' ELSE '' END",
    "CASE WHEN s_suppkey % 11 = 0 THEN 'Also [[' || s_name || ']].' ELSE '' END",
    "''",
    "'## Mentioned In'",
    "''",
    "'- [[Order ' || s_suppkey || ']]'",
    "''",
)

_CUSTOMER_PAGE = _lines(
    "'---'",
    "'type: entity'",
    "'tags: [organization, ' || lower(c_mktsegment) || ']'",
    "'sources: [Order ' || c_custkey || CASE WHEN c_custkey % 3 > 0 THEN ', Order ' || (c_custkey + 1) ELSE '' END "
    "|| CASE WHEN c_custkey % 3 > 1 THEN ', Order ' || (c_custkey + 2) ELSE '' END || ']'",
    "'created: 2000-01-0' || (c_custkey % 9 + 1)",
    "'---'",
    "''",
    "'# ' || c_name",
    "''",
    "CASE WHEN c_custkey % 6 = 0 THEN 'A customer.' ELSE 'A customer of the ' || lower(c_mktsegment) || "
    "' market segment based in [[NATION_' || c_nationkey || ']].' END",
    "''",
)

_PART_PAGE = _lines(
    "'---'",
    "'type: ' || CASE WHEN p_partkey % 3 = 0 THEN 'concept' ELSE 'entity' END",
    "'tags: [' || kind || ', ' || lower(p_brand) || ']'",
    "'sources: [Order ' || p_partkey || ', Order ' || (p_partkey % 50) || ', order ' || (p_partkey % 50) || ']'",
    "'source_dates: [' || (1990 + p_partkey % 30) || '-01, ' || (1990 + p_partkey % 17) || ']'",
    "'created: 2001-01-01'",
    "'updated: 2001-01-01'",
    "'---'",
    "''",
    "'# ' || name",
    "''",
    "CASE WHEN p_partkey % 4 = 2 THEN '> **Disambiguation:** see also [[Widget ' || block || ']] — distinct entry "
    "that shares this name.' ELSE '> A catalogued part.' END",
    "''",
    "CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN 'mentioned in the catalog' ELSE "
    "'A ' || p_name || ' made by the brand for the ' || lower(p_type) || ' line of widgets' END",
    "''",
    "'### From [[Order ' || p_partkey || ']]'",
    "''",
    "'Of size ' || p_size || '.'",
    "''",
    "'## Mentioned In'",
    "''",
    "'- [[Order ' || p_partkey || ']]'",
    "''",
)

_NATION_PAGE = _lines(
    "'---'", "'type: concept'", "'tags: [\"place\", ''nation'']'", "'sources: []'",
    "'created: 1995-05-05'", "'type: place'", "'---'", "''",
    "'# ' || n_name", "''",
    "'A nation of region [[' || CASE n_regionkey WHEN 0 THEN 'africa' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'Asia' "
    "WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END || '|its region]], key ' || n_nationkey || '.'",
    "''",
)

WIKI_SQL = f"""
SELECT 'sources' AS subdir, 'Order ' || o_orderkey AS name, {_ORDER_PAGE} AS content FROM {{orders}}
UNION ALL
SELECT 'entities', s_name, {_SUPPLIER_PAGE} FROM {{supplier}}
UNION ALL
SELECT 'entities', c_name, {_CUSTOMER_PAGE} FROM {{customer}}
UNION ALL
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'concepts' ELSE 'entities' END, name, {_PART_PAGE}
FROM (SELECT *, {_widget('block', 'p_partkey % 4', 'kind')} AS name
      FROM (SELECT *, {_KIND} AS kind, CAST(floor(p_partkey / 4.0) AS BIGINT) AS block FROM {{part}}) k) n
UNION ALL
SELECT 'concepts', n_name, {_NATION_PAGE} FROM {{nation}}
UNION ALL
SELECT 'sources', r_name, 'No front matter for ' || r_name || '.' FROM {{region}}
UNION ALL
SELECT 'synthesis', r_name, {_lines("'---'", "'type: synthesis'", "'tags: [query]'", "'# ' || r_name", "'never closed [[NATION_' || r_regionkey || ']]'")} FROM {{region}}
"""

# One catalog line per page, some missing, some stale, some in the aliased form.
CATALOG_SQL = """
SELECT '## Entities' AS section, '- [[' || CASE WHEN s_suppkey % 4 = 1 THEN lower(s_name) ELSE s_name END
       || CASE WHEN s_suppkey % 6 = 0 THEN '|alias' ELSE '' END || ']] — supplier' AS line FROM {supplier}
UNION ALL
SELECT '## Entities', CASE WHEN c_custkey % 5 = 0 THEN '- plain ' || c_name ELSE '- [[' || c_name || ']] — customer' END FROM {customer}
UNION ALL
SELECT '## Concepts', '- [[' || n_name || ']] — nation and [[gone-' || n_nationkey || ']]' FROM {nation}
UNION ALL
SELECT '## Sources', '- [[Order ' || o_orderkey || ']] — order' FROM {orders}
"""

# Gazetteer: one canonical entry per part block, in two tiers, with shared aliases.
REGISTRY_SQL = f"""
SELECT 'Widget ' || block AS canonical_name, kind AS canonical_type,
       kind || ',tool,method' AS compatible,
       CASE WHEN block % 3 = 0 THEN '' ELSE 'The catalogued widget number ' || block || ' of the ' || lower(p_type) || ' line' END AS description,
       'W-' || block || '|Shared ' || CAST(floor(block / 2.0) AS BIGINT) || '|Widget ' || (block + 1) || '|Widgets ' || block AS aliases,
       CASE WHEN p_partkey % 3 = 0 THEN 'concepts' ELSE 'entities' END AS subdir,
       CASE WHEN block % 2 = 0 THEN 'seed' ELSE 'promoted' END AS tier, block AS reg_ord
FROM (SELECT *, {_KIND} AS kind, CAST(floor(p_partkey / 4.0) AS BIGINT) AS block FROM {{part}}) k
WHERE p_partkey = block * 4
"""

_MENTION_DESC = (
    "CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'A bolt made by the brand for the economy line of widgets' "
    "WHEN 2 THEN 'Completely unrelated text on weather, tides and oceans' "
    "WHEN 3 THEN 'mentioned in the context of an order' "
    "WHEN 4 THEN 'made by the brand in small batches for collectors of gears' WHEN 5 THEN 'The model' "
    "WHEN 6 THEN 'Widgets line made by the brand' "
    "ELSE 'A red ring made by the brand for the ' || lower(o_orderstatus) || ' promo line of widgets' END"
)
_MENTION_TYPE = (
    "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Tool' WHEN 2 THEN 'method' WHEN 3 THEN 'metric' "
    "WHEN 4 THEN 'software' WHEN 5 THEN 'person' ELSE 'dataset' END"
)

# One extracted mention per order, aimed at the part pages.
MENTIONS_SQL = f"""
SELECT source, pos, subdir, CASE WHEN pos % 5 = 0 THEN upper(name) WHEN pos % 37 = 0 THEN ' ' ELSE name END AS name,
       type, description, source_date
FROM (SELECT 'Order ' || o_orderkey AS source, o_orderkey AS pos,
             CASE WHEN (o_custkey * 4 + o_orderkey % 4) % 3 = 0 THEN 'concepts' ELSE 'entities' END AS subdir,
             {_widget('o_custkey', 'o_orderkey % 4', "'tool'")} AS name,
             {_MENTION_TYPE} AS type, {_MENTION_DESC} AS description,
             CAST(CAST(o_orderdate AS DATE) AS STRING) AS source_date
      FROM {{orders}}) m
"""

# Extracted items with many within-source collisions, two buckets per source.
ITEMS_SQL = f"""
SELECT 'Batch ' || CAST(floor(o_orderkey / 200.0) AS BIGINT) AS source,
       CASE WHEN o_orderkey % 2 = 0 THEN 'entities' ELSE 'concepts' END AS bucket, o_orderkey AS pos,
       {_widget('(o_custkey % 20)', 'CAST(floor(o_orderkey / 2.0) AS BIGINT) % 4', "'tool'")} AS name,
       {_MENTION_TYPE} AS type,
       {_MENTION_DESC} || substr('..........', 1, CAST(o_custkey % 10 AS INT)) AS description
FROM {{orders}}
"""

# One retrieval query per nation: two plain words, one phrase word and one repeated word.
QUESTIONS_SQL = """
SELECT n_nationkey AS query_id,
       'Supplier nation_' || n_nationkey || ' widget ' || (n_nationkey * 3) || ' order of priority URGENT order' AS text
FROM {nation}
"""

_SOURCES_OF = {
    "wiki": WIKI_SQL,
    "catalog": CATALOG_SQL,
    "registry": REGISTRY_SQL,
    "mentions": MENTIONS_SQL,
    "items": ITEMS_SQL,
    "questions": QUESTIONS_SQL,
}


# Tables whose rows grow into long texts or many keys: worth spreading when they come in few splits.
_GROWING = ("orders", "customer", "supplier", "part")


_KNOWN_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _KNOWN_SCHEMAS:
        _KNOWN_SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_KNOWN_SCHEMAS[path]).parquet(path)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a Spark plan over the tables it needs."""
    text = _SOURCES_OF[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    grow_shuffles(spark, sum(stored_bytes(df) for t, df in used.items() if t in _GROWING))
    used = {t: spread(df, SPLIT_BYTES) if t in _GROWING else df for t, df in used.items()}
    return spark.sql(text.replace("{hash}", "sha2('order ' || o_orderkey, 256)"), **used)


def ansi(name: str) -> str:
    """The same relation as ANSI SQL over the bare table names."""
    text = _SOURCES_OF[name].replace("{hash}", "sha256('order ' || o_orderkey)")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.strip()
