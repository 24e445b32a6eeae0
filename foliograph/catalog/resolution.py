"""Registered queries: gazetteer, similarity, resolution stages, folds and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.catalog import sql as S
from foliograph.catalog.registry import query
from foliograph.functions import similarity as M
from foliograph.functions import text as T
from foliograph.operators import calibrate, folds, registry, resolve


def _entries(t):
    r = t.registry
    return r.select(
        "canonical_name", "canonical_type", F.split("compatible", ",").alias("compatible_types"), "description",
        F.split("aliases", r"\|").alias("aliases"), "subdir", "tier", "reg_ord",
    )


S.CTES.update({
    "prim": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier <> 'seed' DESC, reg_ord DESC) AS rn FROM (SELECT *, {S.alias_key('canonical_name')} AS key FROM registry)) WHERE rn = 1 AND key <> ''",
    "al": f"SELECT {S.alias_key('canonical_name')} AS pk, tier, reg_ord, unnest(string_split(aliases, '|')) AS alias, generate_subscripts(string_split(aliases, '|'), 1) AS pos FROM registry",
    "aidx": f"SELECT key, key AS primary_key FROM prim UNION ALL SELECT k, pk FROM (SELECT {S.alias_key('alias')} AS k, pk, row_number() OVER (PARTITION BY {S.alias_key('alias')} ORDER BY tier <> 'seed' DESC, reg_ord DESC, pos DESC) AS rn FROM al) WHERE rn = 1 AND k <> '' AND k NOT IN (SELECT key FROM prim)",
    "looked": f"""SELECT m.*, p.canonical_name AS e_name, p.canonical_type AS e_type, p.description AS e_description FROM (SELECT *, {S.alias_key('name')} AS sk FROM mentions) m
      LEFT JOIN aidx a ON a.key = m.sk LEFT JOIN prim p ON p.key = a.primary_key AND p.subdir = m.subdir
      AND (lower({S.trim('m.type')}) = '' OR list_contains(string_split(p.compatible, ','), lower({S.trim('m.type')})))""",
    "meta": f"""SELECT * FROM (SELECT subdir, lower(name) AS page_key, name AS p_name, {S.first_tag()} AS p_type, {S.description()} AS p_description,
      list_filter(list_transform(string_split(regexp_extract({S.field('source_dates')}, '\\[([^\\]]*)\\]', 1), ','), lambda v: {S.trim('v')}), lambda v: v <> '') AS p_dates,
      row_number() OVER (PARTITION BY subdir, lower(name) ORDER BY name) AS rn FROM wiki WHERE subdir IN ('entities', 'concepts')) WHERE rn = 1""",
    "paired": f"""SELECT l.*, {S.trim('l.name')} AS nm, {S.safe_name(S.trim('l.name'))} AS safe, p.p_name, p.p_type, p.p_description, p.p_dates,
      {S.stems('l.description')} AS sa, {S.stems('p.p_description')} AS sb, lower({S.trim('l.type')}) AS nt, lower({S.trim("coalesce(p.p_type, '')")}) AS ot,
      {S.safe_name('l.e_name')} AS csafe FROM looked l LEFT JOIN meta p ON p.subdir = l.subdir AND p.page_key = lower({S.safe_name(S.trim('l.name'))})""",
    "simmed": f"SELECT *, CASE WHEN p_name IS NULL THEN 0.0 ELSE round({S.jaccard('sa', 'sb')}, 6) END AS sim, {S.fork_name('safe', 'nt')} AS fork FROM paired",
    "early": f"""SELECT *, CASE
      WHEN nm = '' THEN 'create|1|Untitled|0.0'
      WHEN e_name IS NOT NULL AND (subdir, csafe) IN (SELECT subdir, p_name FROM meta) THEN 'merge|0|' || csafe || '|1.0'
      WHEN e_name IS NOT NULL THEN 'create|0|' || csafe || '|1.0'
      WHEN p_name IS NULL THEN 'create|1|' || safe || '|0.0'
      WHEN nt <> '' AND ot <> '' AND NOT {S.compatible('nt', 'ot')} AND sim < 0.55 THEN 'fork|2|' || fork || '|' || sim
      WHEN sim >= 0.55 THEN 'merge|3|' || p_name || '|' || sim
      WHEN sim < 0.15 AND NOT ({S.context_local('description', 'nm')} AND {S.context_local('p_description', 'nm')}) THEN 'fork|3|' || fork || '|' || sim
      WHEN {S.trim('description')} = '' OR {S.trim('p_description')} = '' THEN 'merge|4|' || p_name || '|' || sim END AS out FROM simmed""",
    "keyed": "SELECT *, CASE WHEN out IS NULL THEN sha1(array_to_string(list_sort(["
    + ", ".join(
        f"lower({S.trim(n)}) || chr(2) || lower({S.trim(ty)}) || chr(2) || lower({S.trim(d)})"
        for n, ty, d in (("name", "type", "description"), ("p_name", "p_type", "p_description"))
    )
    + "]), chr(1))) END AS key FROM early",
    "cache": "SELECT key, max(quality) = 1 AS verdict FROM keyed JOIN labels ON labels.doc_id = keyed.pos WHERE key IS NOT NULL GROUP BY key",
    "judged": """SELECT k.*, c.verdict, coalesce(k.out, CASE WHEN c.verdict THEN 'merge|4|' || k.p_name || '|' || k.sim ELSE 'fork|4|' || k.fork || '|' || k.sim END) AS final
      FROM keyed k LEFT JOIN cache c USING (key)""",
})
S._MATERIALIZED.update({"prim", "aidx", "looked", "meta", "paired", "simmed", "early", "keyed"})
LOOKUP = "registry mentions prim al aidx looked"
EARLY = "wiki " + LOOKUP + " meta paired simmed early keyed"


@query("D16_registry_primaries", "SELECT key, canonical_name, canonical_type, tier, reg_ord FROM prim", "registry prim")
def _(t):
    return registry.primaries(_entries(t)).select("key", "canonical_name", "canonical_type", "tier", "reg_ord")


@query("D16_alias_index", "SELECT * FROM aidx", "registry prim al aidx")
def _(t):
    return registry.alias_index(_entries(t))


@query("J12_registry_lookup", "SELECT source, pos, name, e_name AS canonical FROM looked", LOOKUP)
def _(t):
    return registry.lookup(t.mentions, _entries(t)).select("source", "pos", "name", F.col("e_canonical_name").alias("canonical"))


@query("J13_existing_page", "SELECT source, pos, safe, p_name AS existing FROM paired", "wiki " + LOOKUP + " meta paired")
def _(t):
    rows = resolve.with_existing(t.mentions, resolve.page_meta(t.wiki))
    return rows.select("source", "pos", "safe", F.col("p_name").alias("existing"))


_PROMO = rf"""facts AS (SELECT subdir, name, len({S.anchored('sources')}) AS n_sources,
  lower(trim({S.trim(rf"string_split(regexp_extract({S.fm()}, '(?m)^tags:[ \t]*\[([^\]]*)\][ \t]*$', 1), ',')[1]")}, '''"')) AS canonical_type,
  regexp_split_to_array(regexp_replace({S.raw_body()}, '(^|\n)#\s+[^\n]*\n', '\1'), '(?:^|\n)(?:###\s+From\s+\[\[|##\s+(?i:mentioned)\s+(?i:in))')[1] AS t
  FROM wiki WHERE subdir IN ('entities', 'concepts')),
para AS (SELECT subdir, name, n_sources, canonical_type, {S.squeeze(f"coalesce(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {S.trim('p')}), lambda p: p <> '' AND NOT starts_with(p, '>'))[1], '')")} AS p FROM facts),
promo AS (SELECT {S.trim(f"regexp_replace(name, '{K.WS}*[(][^)]*[)]{K.WS}*', ' ', 'g')")} AS canonical_name, canonical_type, subdir, name AS page,
  CASE WHEN length(p) > 400 THEN regexp_replace(left(p, 400), ' [^ ]*$', '') || '...' ELSE p END AS description
  FROM para WHERE n_sources >= 3 AND canonical_type <> '' AND length(p) >= 30)"""


@query("F14_promotable", f"WITH {_PROMO} SELECT * FROM promo", "wiki")
def _(t):
    return registry.promotable(t.wiki).select("canonical_name", "canonical_type", "subdir", "page", "description")


@query(
    "D15_promotion",
    f"WITH {_PROMO} SELECT * FROM promo WHERE {S.alias_key('canonical_name')} NOT IN (SELECT key FROM prim WHERE tier = 'seed')",
    "wiki registry prim",
)
def _(t):
    return registry.promote(t.wiki, _entries(t)).select("canonical_name", "canonical_type", "subdir", "page", "description")


@query(
    "J15_unseeded_pages",
    f"SELECT subdir, name FROM wiki WHERE subdir IN ('entities','concepts') AND {S.alias_key('name')} NOT IN (SELECT key FROM prim WHERE tier = 'seed')",
    "wiki registry prim",
)
def _(t):
    seeds = registry.primaries(_entries(t)).filter(F.col("tier") == "seed").select("key")
    named = t.wiki.filter(F.col("subdir").isin("entities", "concepts")).select("subdir", "name", T.alias_key(F.col("name")).alias("key"))
    return named.join(seeds, "key", "left_anti").drop("key")


@query(
    "R7_jaccard",
    f"""WITH rep AS (SELECT lang, source, {S.stems('min_by(text, doc_id)')} AS rs FROM documents GROUP BY lang, source)
    SELECT doc_id, round({S.jaccard('s', 'rs')}, 6) AS similarity FROM (SELECT doc_id, lang, source, {S.stems('text')} AS s FROM documents) d JOIN rep USING (lang, source)""",
)
def _(t):
    """Every document against the first document of its language and source."""
    d = t.documents.select("doc_id", "lang", "source", T.content_stems(F.col("text")).alias("s"))
    rep = t.documents.groupBy("lang", "source").agg(F.min_by("text", "doc_id").alias("t"))
    rep = rep.select("lang", "source", T.content_stems(F.col("t")).alias("rs"))
    return d.join(rep, ["lang", "source"]).select("doc_id", F.round(M.jaccard(F.col("s"), F.col("rs")), 6).alias("similarity"))


@query("R7_mention_similarity", "SELECT source, pos, sim AS similarity FROM simmed WHERE p_name IS NOT NULL", "wiki " + LOOKUP + " meta paired simmed")
def _(t):
    rows = resolve.with_existing(t.mentions, resolve.page_meta(t.wiki)).filter(F.col("p_name").isNotNull())
    sim = M.description_similarity(F.col("description"), F.col("p_description"))
    return rows.select("source", "pos", F.round(sim, 6).alias("similarity"))


# Each vector against its successor: as many labelled pairs as vectors.
_PAIRS = """pairs AS (SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, a.label = b.label AS same
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
_CURVE = """pos AS (SELECT count(*) FILTER (same) AS p FROM pairs),
curve AS (SELECT cosine, max(tp) AS tp, max(predicted) AS predicted FROM (SELECT cosine, sum(same::INT) OVER w AS tp, count(*) OVER w AS predicted FROM pairs
   WINDOW w AS (ORDER BY cosine DESC RANGE UNBOUNDED PRECEDING)) GROUP BY cosine),
f1 AS (SELECT cosine, tp, predicted, 2 * (tp / predicted) * (tp / p) / (tp / predicted + tp / p) AS f1 FROM curve, pos WHERE tp > 0)"""


def _pairs(t):
    a = t.embeddings.select("vec_id", "embedding", "label")
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    value = F.round(M.cosine(F.col("embedding"), F.col("e2")), 6)
    return a.join(b, "vec_id").select("vec_id", value.alias("cosine"), (F.col("label") == F.col("l2")).alias("same"))


@query("R8_cosine", f"WITH {_PAIRS} SELECT * FROM pairs")
def _(t):
    return _pairs(t)


@query("A21_f1_curve", f"WITH {_PAIRS}, {_CURVE} SELECT cosine, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted, round(f1, 9) AS f1 FROM f1")
def _(t):
    return calibrate.f1_curve(_pairs(t)).withColumn("f1", F.round("f1", 9))


@query("W5_tuned_threshold", f"WITH {_PAIRS}, {_CURVE} SELECT min(cosine) AS threshold FROM f1 WHERE round(f1, 12) = (SELECT max(round(f1, 12)) FROM f1)")
def _(t):
    return calibrate.tuned_threshold(_pairs(t))


@query(
    "R15_embedding_stage",
    f"""WITH {_PAIRS}, {_CURVE}, best AS (SELECT min(cosine) AS th FROM f1 WHERE round(f1, 12) = (SELECT max(round(f1, 12)) FROM f1))
    SELECT vec_id, CASE WHEN cosine >= th THEN 'merge' ELSE 'fork' END AS action FROM pairs, best""",
)
def _(t):
    pairs = _pairs(t)
    rows = pairs.select(
        "vec_id", "cosine", F.lit(None).cast("boolean").alias("verdict"), F.lit(0.3).alias("sim"),
        F.lit("page").alias("p_name"), F.lit("page (alt)").alias("fork"),
        F.lit(None).cast("struct<action:string,resolved_name:string,stage:int,reason:string,similarity:double>").alias("out"),
    )
    done = resolve.late_stages(rows, calibrate.tuned_threshold(pairs).scalar())
    return done.select("vec_id", "out.action")


@query(
    "J16_age_gap",
    f"""SELECT source, pos, coalesce(list_max(list_transform(list_filter(list_transform(p_dates, lambda d: {S.year('d')}), lambda y: y IS NOT NULL),
        lambda y: abs(y - {S.year('source_date')}))), 0) AS gap FROM paired WHERE p_name IS NOT NULL""",
    "wiki " + LOOKUP + " meta paired",
)
def _(t):
    rows = resolve.with_existing(t.mentions, resolve.page_meta(t.wiki)).filter(F.col("p_name").isNotNull())
    return rows.select("source", "pos", M.age_gap(F.array("source_date"), F.col("p_dates")).alias("gap"))


def _early(t, use_embeddings=False):
    return resolve.early_rows(t.mentions, t.wiki, _entries(t), use_embeddings)


def _cache(t, early):
    """Verdicts for the open pairs: quality labels 1 and 0, no label meaning unsure."""
    opened = early.filter(F.col("key").isNotNull()).select("key", "pos")
    labels = t.labels.select(F.col("doc_id").alias("pos"), "quality")
    return opened.join(labels, "pos").groupBy("key").agg((F.max("quality") == 1).alias("verdict"))


@query(
    "R9_to_R12_early_stages",
    "SELECT source, pos, split_part(out, '|', 1) AS action, CAST(split_part(out, '|', 2) AS INTEGER) AS stage, split_part(out, '|', 3) AS resolved_name, CAST(split_part(out, '|', 4) AS DOUBLE) AS similarity FROM early WHERE out IS NOT NULL",
    EARLY,
)
def _(t):
    done = _early(t).filter(F.col("out").isNotNull())
    return done.select("source", "pos", "out.action", "out.stage", "out.resolved_name", "out.similarity")


@query(
    "R13_age_gap_forks",
    f"""SELECT source, pos, fork AS resolved_name FROM early WHERE (out IS NULL OR starts_with(out, 'merge|4|')) AND p_name IS NOT NULL
    AND list_max(list_transform(list_filter(list_transform(p_dates, lambda d: {S.year('d')}), lambda y: y IS NOT NULL), lambda y: abs(y - {S.year('source_date')}))) >= 10""",
    EARLY,
)
def _(t):
    drift = _early(t, use_embeddings=True).filter(F.col("out.reason") == "age gap")
    return drift.select("source", "pos", "out.resolved_name")


@query("R17_judge_key", "SELECT source, pos, key FROM keyed WHERE key IS NOT NULL", EARLY)
def _(t):
    return _early(t).filter(F.col("key").isNotNull()).select("source", "pos", "key")


_FINAL = "split_part(final, '|', 1) AS action, CAST(split_part(final, '|', 2) AS INTEGER) AS stage, split_part(final, '|', 3) AS resolved_name"


def _resolved(t):
    return resolve.resolve(t.mentions, t.wiki, _entries(t), lambda early: _cache(t, early))


@query(
    "R16_resolve_batch",
    f"""SELECT source, pos, {_FINAL}, p_name AS existing_name,
    CASE WHEN e_name IS NOT NULL AND nm <> '' AND e_type <> '' THEN e_type ELSE type END AS type,
    CASE WHEN e_name IS NOT NULL AND nm <> '' AND e_description <> '' AND (length({S.trim('description')}) < 30 OR {S.context_local(S.trim('description'), 'name')})
      THEN e_description ELSE description END AS description FROM judged""",
    EARLY + " cache judged",
)
def _(t):
    return _resolved(t).select("source", "pos", "action", "stage", "resolved_name", "existing_name", "type", "description")


@query(
    "R14_judged_pairs",
    f"SELECT source, pos, verdict, {_FINAL} FROM judged WHERE out IS NULL", EARLY + " cache judged",
)
def _(t):
    return _resolved(t).filter(F.col("key").isNotNull()).select("source", "pos", "verdict", "action", "stage", "resolved_name")


@query(
    "A14_action_counts",
    "SELECT subdir, count(*) AS items, count(*) FILTER (starts_with(final, 'create')) AS \"create\", count(*) FILTER (starts_with(final, 'merge')) AS merge, count(*) FILTER (starts_with(final, 'fork')) AS fork FROM judged GROUP BY 1",
    EARLY + " cache judged",
)
def _(t):
    return resolve.action_counts(_resolved(t))


@query("D11_fork_name", f"SELECT source, pos, {S.fork_name('safe', 'nt')} AS fork FROM paired", "wiki " + LOOKUP + " meta paired")
def _(t):
    safe = T.safe_name(T.trim_ws(F.col("name")))
    return t.mentions.select("source", "pos", T.fork_name(safe, F.lower(T.trim_ws(F.col("type")))).alias("fork"))


# --- folds -----------------------------------------------------------------------------------------

_FOLD = f"""ik AS MATERIALIZED (SELECT *, {S.dedup_key('name')} AS key, length(description) AS len FROM items),
seq AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY source, bucket, key) AS n, min(pos) OVER (PARTITION BY source, bucket, key) AS p0
  FROM ik WINDOW w AS (PARTITION BY source, bucket, key ORDER BY pos)),
fold AS (SELECT source, bucket, key, i, n, p0, name, type, description FROM seq WHERE i = 1
  UNION ALL
  SELECT f.source, f.bucket, f.key, s.i, f.n, f.p0,
    CASE WHEN s.len > length(f.description) THEN CASE WHEN length(s.name) > length(f.name) THEN f.name ELSE s.name END
         WHEN length(s.name) < length(f.name) THEN s.name ELSE f.name END,
    CASE WHEN s.len > length(f.description) THEN s.type ELSE f.type END,
    CASE WHEN s.len > length(f.description) THEN s.description ELSE f.description END
  FROM fold f JOIN seq s ON s.source = f.source AND s.bucket = f.bucket AND s.key = f.key AND s.i = f.i + 1),
folded AS (SELECT source, bucket, key, p0 AS pos, name, type, description, n FROM fold WHERE i = n)"""


@query("A10_item_fold", f"WITH RECURSIVE {_FOLD} SELECT * FROM folded", "items")
def _(t):
    return folds.fold_items(t.items)


@query(
    "D14_cross_bucket",
    f"""WITH RECURSIVE {_FOLD},
    e AS (SELECT * FROM folded WHERE bucket = 'entities'), c AS (SELECT * FROM folded WHERE bucket = 'concepts'),
    j AS (SELECT coalesce(e.source, c.source) AS source, e.pos AS ep, c.pos AS cp, e.name AS en, c.name AS cn, e.type AS et, c.type AS ct,
      e.description AS ed, c.description AS cd, {S.type_home("coalesce(e.type, '')")} AS eh, {S.type_home("coalesce(c.type, '')")} AS ch
      FROM e FULL JOIN c ON e.source = c.source AND e.key = c.key),
    w AS (SELECT *, CASE WHEN cp IS NULL THEN 'entities' WHEN ep IS NULL THEN 'concepts'
      WHEN eh = 'entities' AND ch <> 'entities' THEN 'entities' WHEN ch = 'concepts' AND eh <> 'concepts' THEN 'concepts'
      WHEN eh = 'concepts' AND ch = '' THEN 'concepts' WHEN ch = 'entities' AND eh = '' THEN 'entities' ELSE 'concepts' END AS bucket FROM j)
    SELECT source, bucket, CASE bucket WHEN 'entities' THEN ep ELSE cp END AS pos,
      CASE WHEN ep IS NULL THEN cn WHEN cp IS NULL THEN en WHEN length(en) < length(cn) THEN en ELSE cn END AS name,
      CASE bucket WHEN 'entities' THEN et ELSE ct END AS type,
      CASE WHEN ep IS NULL THEN cd WHEN cp IS NULL THEN ed WHEN length(ed) > length(cd) THEN ed ELSE cd END AS description,
      ep IS NOT NULL AND cp IS NOT NULL AS collided FROM w""",
    "items",
)
def _(t):
    return folds.cross_bucket(folds.fold_items(t.items))


@query(
    "J14_bucket_collisions",
    f"WITH ik AS (SELECT DISTINCT source, bucket, {S.dedup_key('name')} AS key FROM items) SELECT e.source, e.key FROM ik e JOIN ik c USING (source, key) WHERE e.bucket = 'entities' AND c.bucket = 'concepts'",
    "items",
)
def _(t):
    keyed = t.items.select("source", "bucket", T.dedup_key(F.col("name")).alias("key"))
    return keyed.groupBy("source", "key").agg(F.count_if(F.col("bucket") == "entities").alias("e"), F.count_if(F.col("bucket") == "concepts").alias("c")).filter(
        "e > 0 and c > 0"
    ).select("source", "key")


_CHUNKS = """ch AS (SELECT CAST(floor(doc_id / 25.0) AS BIGINT) AS source, doc_id AS chunk, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Title ' || doc_id END AS title,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang || ' summary ' || n_chars END AS summary, string_split(text, '. ') AS key_claims FROM documents)"""


def _chunks(t):
    d = F.col("doc_id")
    return t.documents.select(
        F.floor(d / 25).alias("source"), d.alias("chunk"),
        F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("Title "), d.cast("string"))).alias("title"),
        F.when(d % 4 == 0, "").otherwise(F.concat(F.col("lang"), F.lit(" summary "), F.col("n_chars").cast("string"))).alias("summary"),
        F.split("text", r"\. ").alias("key_claims"),
    )


@query("A11_titles", f"WITH {_CHUNKS} SELECT source, coalesce(min_by(title, chunk) FILTER (title <> ''), '') AS title FROM ch GROUP BY 1")
def _(t):
    return folds.merge_titles(_chunks(t))


@query("A11_summaries", f"WITH {_CHUNKS} SELECT source, chunk, summary FROM ch WHERE summary <> ''")
def _(t):
    return folds.merge_summaries(_chunks(t))


@query(
    "A11_claims",
    f"""WITH {_CHUNKS}, ex AS (SELECT source, chunk, unnest(key_claims) AS claim, CAST(generate_subscripts(key_claims, 1) - 1 AS INTEGER) AS pos FROM ch)
    SELECT source, claim, chunk, pos FROM (SELECT *, row_number() OVER (PARTITION BY source, claim ORDER BY chunk, pos) AS rn FROM ex) WHERE rn = 1""",
)
def _(t):
    return folds.merge_claims(_chunks(t))


_NORM = f"""norm AS (SELECT source, subdir, pos, CASE WHEN e_name IS NOT NULL AND {S.trim('name')} <> '' THEN e_name ELSE name END AS name,
  CASE WHEN e_name IS NOT NULL AND {S.trim('name')} <> '' AND e_type <> '' THEN e_type ELSE type END AS type,
  CASE WHEN e_name IS NOT NULL AND {S.trim('name')} <> '' AND e_description <> '' AND (length({S.trim('description')}) < 30 OR {S.context_local(S.trim('description'), 'e_name')})
    THEN e_description ELSE description END AS description, e_name IS NOT NULL AND {S.trim('name')} <> '' AS anchored FROM looked)"""


@query("A12_alias_normalization", f"WITH {_NORM} SELECT * FROM norm", LOOKUP)
def _(t):
    return folds.normalize_aliases(t.mentions, _entries(t))


@query(
    "A12_alias_collapse",
    f"""WITH k AS (SELECT source, bucket AS subdir, pos, name, type, description, {S.alias_key('name')} AS key, {S.trim('description')} AS d,
        length({S.trim('description')}) < 30 OR {S.context_local(S.trim('description'), 'name')} AS weak FROM items)
    SELECT source, subdir, min(pos) AS pos, min_by(name, pos) AS name, coalesce(min_by(type, pos) FILTER (type <> ''), '') AS type,
      CASE WHEN count(*) = 1 THEN min(description) ELSE coalesce(max_by(d, length(d) * 10000000 - pos) FILTER (NOT weak), min_by(description, pos)) END AS description, count(*) AS n
    FROM k GROUP BY source, subdir, key""",
    "items",
)
def _(t):
    return folds.collapse_aliases(t.items.withColumnRenamed("bucket", "subdir"))
