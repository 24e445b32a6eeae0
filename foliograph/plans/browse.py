"""Page browsing: listing, single page, search box, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import pages as P
from foliograph.functions.text import computed, is_valid_page_name
from foliograph.operators import graph


def page_listing(pages: DataFrame, subdir: str = "") -> DataFrame:
    """Metadata of every page file, in page-kind and name order."""
    if subdir and subdir not in K.SUBDIRS:
        raise ValueError(f"unknown page kind {subdir!r}")
    chosen = pages.filter(F.col("subdir") == subdir) if subdir else pages
    c = F.col("content")
    rows = chosen.select(
        "subdir", "name", P.field_value(c, "type").alias("page_type"), computed(P.list_items(P.field_value(c, "tags"))).alias("tags"),
        P.field_value(c, "created").alias("created"), P.field_value(c, "updated").alias("updated"),
    )
    return rows.orderBy(graph.subdir_rank(F.col("subdir")), "name")


def filter_pages(listing: DataFrame, text: str) -> DataFrame:
    """Listing rows whose name or joined tags contain the text, ignoring case."""
    needle = text.lower()
    if not needle:
        return listing
    tags = F.lower(F.array_join("tags", " "))
    return listing.filter(F.contains(F.lower("name"), F.lit(needle)) | F.contains(tags, F.lit(needle)))


def get_page(pages: DataFrame, subdir: str, name: str) -> DataFrame:
    """At most one page: the exact name, else one that matches ignoring case."""
    found = pages.filter(
        F.col("subdir").isin(*K.SUBDIRS) & (F.col("subdir") == subdir) & (F.lower("name") == name.lower())
        & is_valid_page_name(F.lit(name))
    )
    best = found.orderBy((F.col("name") == name).desc(), "name").limit(1)
    c = F.col("content")
    return best.select(
        "name", "subdir", "content", P.field_value(c, "type").alias("page_type"),
        P.list_items(P.field_value(c, "tags")).alias("tags"), P.field_value(c, "created").alias("created"),
        P.field_value(c, "updated").alias("updated"), F.array_sort(P.link_targets(c)).alias("outbound_links"),
    )


def wiki_stats(pages: DataFrame) -> DataFrame:
    """One row: page files, link occurrences and broken occurrences."""
    total = pages.agg(F.count("*").alias("n")).scalar()
    return graph.link_stats(pages).select(total.alias("total_pages"), "total_wikilinks", "broken_links")


def reset_preview(pages: DataFrame, raw_files: DataFrame) -> DataFrame:
    """What a reset would remove: files and bytes per page kind and for the raw folder."""
    wiki = pages.groupBy(F.col("subdir").alias("area")).agg(
        F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes")
    )
    raw = raw_files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return wiki.unionByName(raw.select(F.lit("raw").alias("area"), "files", "bytes"))
