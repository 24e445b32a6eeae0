"""The link graph of a wiki: resolution of link texts, degrees, broken links, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import pages as P
from foliograph.functions.text import node_radius


def subdir_rank(subdir: Column) -> Column:
    """Position of a page kind in the fixed kind order."""
    return F.array_position(F.array(*[F.lit(s) for s in K.SUBDIRS]), subdir).cast("int")


def unique_pages(pages: DataFrame) -> DataFrame:
    """One page per name; a later page kind replaces an earlier one.

    Only names are grouped. Page texts meet the short list of colliding names and are not
    shuffled while Spark measures that list as small enough to broadcast.
    """
    ranked = pages.groupBy("name").agg(F.max(subdir_rank(F.col("subdir"))).alias("top"), F.count("*").alias("n"))
    colliding = ranked.filter(F.col("n") > 1).select("name", "top")
    kept = F.col("top").isNull() | (subdir_rank(F.col("subdir")) == F.col("top"))
    return pages.join(colliding, "name", "left").filter(kept).select(*pages.columns)


def page_keys(pages: DataFrame) -> DataFrame:
    """Lower-case name → page name, unique (the greatest spelling of a colliding name)."""
    return pages.groupBy(F.lower("name").alias("link_key")).agg(F.max("name").alias("dst"))


def distinct_links(pages: DataFrame) -> DataFrame:
    """(src, link_text): every distinct link text of every page."""
    return pages.select(F.col("name").alias("src"), F.explode(P.link_targets(F.col("content"))).alias("link_text"))


def link_occurrences(pages: DataFrame) -> DataFrame:
    """(src, occ, link_text): every link in text order."""
    return pages.select(
        F.col("name").alias("src"), F.posexplode(P.link_occurrences(F.col("content"))).alias("occ", "link_text")
    )


def resolve(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Left join of link texts to page names ignoring case; ``dst`` is NULL for broken links."""
    keyed = links.withColumn("link_key", F.lower("link_text"))
    return keyed.join(page_keys(pages), "link_key", "left").drop("link_key")


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, link_text) between different pages, one row per distinct link text."""
    return resolve(distinct_links(pages), pages).filter(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))


def target_counts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Resolve link texts after counting them, so a hot target reaches the join as one row.

    Returns (link_text, dst, n) with ``n`` the number of links and dst NULL for broken texts.
    """
    counted = links.groupBy("link_text").agg(F.count("*").alias("n"))
    return resolve(counted, pages)


def graph_nodes(pages: DataFrame) -> DataFrame:
    """(name, subdir, link_count, radius) with in-degree counted per distinct link text."""
    linked = edges(pages).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n"))
    nodes = unique_pages(pages).select("name", "subdir").join(linked, "name", "left")
    count = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return nodes.select("name", "subdir", count.alias("link_count"), node_radius(count).alias("radius"))


def graph_edges(pages: DataFrame) -> DataFrame:
    return edges(unique_pages(pages)).select(F.col("src").alias("source"), F.col("dst").alias("target"))


def neighbours(pages: DataFrame) -> DataFrame:
    """Symmetric, distinct (name, neighbour) pairs."""
    forward = edges(pages).select(F.col("src").alias("name"), F.col("dst").alias("neighbour"))
    backward = forward.select(F.col("neighbour").alias("name"), F.col("name").alias("neighbour"))
    return forward.unionByName(backward).distinct()


def broken_links(pages: DataFrame) -> DataFrame:
    """(target, page): link texts without a page, one row per distinct referring page."""
    links = distinct_links(pages).withColumn("link_key", F.lower("link_text"))
    return (
        links.join(page_keys(pages), "link_key", "left_anti")
        .select(F.col("link_text").alias("target"), F.col("src").alias("page"))
        .distinct()
    )


def orphans(pages: DataFrame) -> DataFrame:
    """Pages no link resolves to. A page linking to itself is not an orphan."""
    names = pages.select("name").distinct().filter(~F.col("name").isin("index", "log"))
    targets = target_counts(distinct_links(pages), pages).filter(F.col("dst").isNotNull())
    return names.join(targets.select(F.col("dst").alias("name")), "name", "left_anti")


def isolated(pages: DataFrame) -> DataFrame:
    """Pages without any link text."""
    return pages.filter(F.size(P.link_occurrences(F.col("content"))) == 0).select("name")


def inbound(pages: DataFrame, name: str) -> DataFrame:
    """Pages linking to ``name``, ignoring case and pages of the same name."""
    target = name.lower()
    return (
        pages.filter(F.lower("name") != target)
        .filter(F.exists(P.link_occurrences(F.col("content")), lambda t: F.lower(t) == target))
        .select("name")
        .distinct()
    )


def inbound_pairs(pages: DataFrame) -> DataFrame:
    """(name, page) for every page at once: distinct pages of other names that link to it."""
    resolved = resolve(distinct_links(pages), pages)
    return (
        resolved.filter(F.col("dst").isNotNull() & (F.lower("dst") != F.lower("src")))
        .select(F.col("dst").alias("name"), F.col("src").alias("page"))
        .distinct()
    )


def link_stats(pages: DataFrame) -> DataFrame:
    """One row: total and broken link occurrences."""
    counted = target_counts(link_occurrences(pages), pages)
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_wikilinks"),
        F.coalesce(F.sum(F.when(F.col("dst").isNull(), F.col("n"))), F.lit(0)).alias("broken_links"),
    )


def node_color(name: Column, groups: list[tuple[str, str]], default: str) -> Column:
    """Colour of the first group one of whose keywords is part of the name."""
    color = None
    for keywords, value in groups:
        terms = keywords.lower().split()
        if not terms:
            continue
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(F.lower(name), F.lit(term))
        color = F.when(hit, F.lit(value)) if color is None else color.when(hit, F.lit(value))
    return F.lit(default) if color is None else color.otherwise(F.lit(default))


def bounding_box(points: DataFrame) -> DataFrame:
    """Extent of positioned nodes, radius included."""
    return points.agg(
        F.min(F.col("x") - F.col("radius")).alias("min_x"),
        F.max(F.col("x") + F.col("radius")).alias("max_x"),
        F.min(F.col("y") - F.col("radius")).alias("min_y"),
        F.max(F.col("y") + F.col("radius")).alias("max_y"),
    )
