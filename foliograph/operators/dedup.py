"""Duplicate pages: clusters, survivors, merged metadata, rewrite and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import pages as P
from foliograph.functions import rewrite as R
from foliograph.functions.text import alias_key, blank, dedup_key, safe_name, trim_ws
from foliograph.operators import registry
from foliograph.operators.graph import subdir_rank
from foliograph.session import persist_durably

LIST_FIELDS = ("sources", "source_dates", "tags")


def _member_order(subdir: Column, name: Column) -> Column:
    """Scan order: entities before concepts, then by name."""
    return F.struct(F.when(subdir == "entities", 0).otherwise(1).alias("kind"), name.alias("name"))


def members(pages: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Entity and concept pages with cluster key and survivor order; no page text goes further."""
    c = F.col("content")
    tags = P.anchored_list(c, "tags")
    rows = pages.filter(F.col("subdir").isin("entities", "concepts")).select(
        "subdir", "name", F.length(P.description(c)).alias("desc_len"),
        F.transform(tags, F.lower).alias("tags"), F.coalesce(F.lower(F.get(tags, F.lit(0))), F.lit("")).alias("type"),
    )
    if entries is None:
        rows = rows.withColumn("e_canonical_name", F.lit(None).cast("string"))
    else:
        rows = registry.lookup(rows, entries).select("subdir", "name", "desc_len", "tags", "type", "e_canonical_name")
    canonical = F.coalesce(F.col("name") == safe_name(F.col("e_canonical_name")), F.lit(False))
    concept = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in K.CONCEPT_TYPES]))
    entity = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in K.ENTITY_TYPES]))
    routed = F.when(F.col("subdir") == "concepts", concept).otherwise(entity & ~concept)
    key = F.when(
        F.col("e_canonical_name").isNotNull(), F.concat(F.lit("alias::"), alias_key(F.col("e_canonical_name")))
    ).otherwise(F.concat(F.lit("stem::"), dedup_key(F.col("name"))))
    order = F.struct(
        (~canonical).alias("not_canonical"),
        F.when(canonical, False).otherwise(~routed).alias("misrouted"),
        F.contains(F.col("name"), F.lit("(")).alias("parens"),
        F.length("name").alias("length"),
        (-F.col("desc_len")).alias("shortness"),
        _member_order(F.col("subdir"), F.col("name")).alias("scan"),
    )
    return rows.select("subdir", "name", key.alias("group_key"), order.alias("order"))


def survivors(rows: DataFrame) -> DataFrame:
    """(group_key, keep_subdir, keep_name, n) of clusters with at least two members."""
    best = rows.groupBy("group_key").agg(
        F.min_by(F.struct("subdir", "name"), "order").alias("keep"), F.count("*").alias("n")
    )
    return best.filter(F.col("n") > 1).select(
        "group_key", F.col("keep.subdir").alias("keep_subdir"), F.col("keep.name").alias("keep_name"), "n"
    )


def plan(pages: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(group_key, subdir, name, role, keep_subdir, keep_name, n): what would be kept and merged."""
    rows = members(pages, entries)
    joined = rows.select("group_key", "subdir", "name").join(survivors(rows), "group_key")
    kept = (F.col("subdir") == F.col("keep_subdir")) & (F.col("name") == F.col("keep_name"))
    return joined.withColumn("role", F.when(kept, "keep").otherwise("merge"))


def plan_totals(planned: DataFrame) -> DataFrame:
    return planned.agg(
        F.count_if(F.col("role") == "keep").alias("groups"), F.count_if(F.col("role") == "merge").alias("merged")
    )


def merged_lists(pages: DataFrame, planned: DataFrame) -> DataFrame:
    """(group_key, field, item, at): distinct list items of each cluster at their first place.

    The survivor's items come first, then the others' in scan order; spellings that differ in
    case only count once. Long form, so a huge cluster stays many small rows.
    """
    c = F.col("content")
    fields = F.create_map(*[x for f in LIST_FIELDS for x in (F.lit(f), P.anchored_list(c, f))])
    lists = pages.select("subdir", "name", F.explode(fields).alias("field", "items"))
    rows = planned.join(lists, ["subdir", "name"]).select(
        "group_key", "field", (F.col("role") == "merge").alias("loser"),
        _member_order(F.col("subdir"), F.col("name")).alias("scan"), F.posexplode("items").alias("pos", "item"),
    )
    first = rows.groupBy("group_key", "field", F.lower("item").alias("item_key")).agg(
        F.min(F.struct(F.struct("loser", "scan", "pos").alias("at"), "item")).alias("f")
    )
    return first.select("group_key", "field", F.col("f.item").alias("item"), F.col("f.at").alias("at"))


def rename_map(planned: DataFrame) -> DataFrame:
    """(old, new): merged page names and their survivors; the last cluster wins for a repeated name."""
    losers = planned.filter(F.col("role") == "merge")
    order = F.struct("group_key", _member_order(F.col("subdir"), F.col("name")))
    return losers.groupBy(F.col("name").alias("old")).agg(F.max_by("keep_name", order).alias("new"))


def rewrite_links(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """Pages with every ``[[old]]`` renamed. Only pages that hold a renamed link get a map."""
    tokens = pages.select("subdir", "name", F.explode(R.plain_link_tokens(F.col("content"))).alias("old"))
    hits = tokens.join(renames, "old").groupBy("subdir", "name").agg(
        F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("renames")
    )
    joined = pages.join(hits, ["subdir", "name"], "left")
    return joined.withColumn("content", R.rename_links(F.col("content"), F.col("renames"))).select(*pages.columns)


def rewritten_pages(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """(subdir, name): pages whose text a rename changes."""
    tokens = pages.select("subdir", "name", F.explode(R.plain_link_tokens(F.col("content"))).alias("old"))
    changed = renames.filter(F.col("old") != F.col("new"))
    return tokens.join(changed, "old", "left_semi").select("subdir", "name").distinct()


def _ordered_items(merged: DataFrame, field: str) -> Column:
    """List of one field in merge order. One page's own list: the size of the page it goes into."""
    rows = F.collect_list(F.when(F.col("field") == field, F.struct("at", "item")))
    return F.transform(F.sort_array(rows), lambda r: r["item"])


def merged_survivors(pages: DataFrame, planned: DataFrame) -> DataFrame:
    """Survivor pages (subdir, name, content) with merged lists, mentions and without stale notes."""
    merged = merged_lists(pages, planned)
    lists = merged.groupBy("group_key").agg(*[_ordered_items(merged, f).alias(f"m_{f}") for f in LIST_FIELDS])
    keep = planned.filter(F.col("role") == "keep").select("group_key", "subdir", "name")
    kept = keep.join(pages, ["subdir", "name"])
    losers = planned.filter(F.col("role") == "merge").select("group_key", F.lower("name").alias("target")).distinct()
    notes = kept.select("group_key", F.explode(R.callout_targets(F.col("content"))).alias("target")).distinct()
    stale = notes.join(losers, ["group_key", "target"], "left_semi").groupBy("group_key").agg(
        F.collect_set("target").alias("stale")
    )
    none = F.array().cast("array<string>")
    rows = kept.join(lists, "group_key", "left").join(stale, "group_key", "left")
    rows = rows.select(
        "subdir", "name", "content", P.anchored_list(F.col("content"), "sources").alias("own"),
        *[F.coalesce(F.col(f"m_{f}"), none).alias(f"m_{f}") for f in LIST_FIELDS], F.coalesce("stale", none).alias("stale"),
    )
    listed = rows.withColumn(
        "content", R.replace_list_fields(F.col("content"), F.col("m_sources"), F.col("m_source_dates"), F.col("m_tags"))
    )
    cleaned = listed.withColumn("content", R.strip_callouts(F.col("content"), F.col("stale")))
    added = F.array_except("m_sources", "own")
    return cleaned.select("subdir", "name", R.append_mentions(F.col("content"), added).alias("content"))


def apply(pages: DataFrame, planned: DataFrame) -> DataFrame:
    """The wiki after the plan: merged survivors, losers gone, links following the renames."""
    planned = persist_durably(planned, "merge-plan")
    touched = planned.select("subdir", "name")
    untouched = pages.select("subdir", "name", "content").join(touched, ["subdir", "name"], "left_anti")
    remaining = untouched.unionByName(merged_survivors(pages, planned))
    return rewrite_links(remaining, rename_map(planned))


# --- merges chosen by hand ------------------------------------------------------------------------


def locate(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Names to page files: the first page kind that has the name."""
    found = pages.join(names.select("name").distinct(), "name")
    return found.groupBy("name").agg(
        F.min_by(F.struct("subdir", "content"), subdir_rank(F.col("subdir"))).alias("f")
    ).select("name", "f.subdir", "f.content")


def apply_selected(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """The wiki after hand-picked merges (canonical, pos, name).

    Bodies are appended to the canonical page under a note in the chosen order, merged pages
    are deleted, and ``[[name]]`` follows. Rows with an invalid or unknown name do nothing.
    """
    def valid(c: Column) -> Column:
        return (trim_ws(blank(c)) != "") & ~blank(c).rlike(r"\.\.|/|\\")

    chosen = selection.filter(valid(F.col("canonical")) & valid(F.col("name")))
    targets = locate(pages, chosen.select(F.col("canonical").alias("name"))).withColumnRenamed("name", "canonical")
    dups = locate(pages, chosen.select("name")).select(
        "name", F.col("subdir").alias("d_subdir"), trim_ws(P.body(F.col("content"))).alias("body")
    )
    parts = chosen.join(targets.select("canonical"), "canonical", "left_semi").join(dups, "name")
    block = F.concat(F.lit("\n\n---\n> *Merged from "), F.col("name"), F.lit("*\n\n"), F.col("body"))
    bodies = parts.groupBy("canonical").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("body") != "", block).otherwise("").alias("b")))), lambda x: x["b"]),
            "",
        ).alias("addition")
    )
    merged = targets.join(bodies, "canonical").select(
        "subdir", F.col("canonical").alias("name"), F.concat("content", "addition").alias("content")
    )
    gone = parts.select(F.col("d_subdir").alias("subdir"), "name").distinct()
    replaced = merged.select("subdir", "name").unionByName(gone).distinct()
    rest = pages.select("subdir", "name", "content").join(replaced, ["subdir", "name"], "left_anti")
    renames = parts.groupBy(F.col("name").alias("old")).agg(F.max_by("canonical", "pos").alias("new"))
    return rewrite_links(rest.unionByName(merged), renames)
