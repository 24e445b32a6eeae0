"""Wiki health checks as finding relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import pages as P
from foliograph.functions.text import computed, trim_ws
from foliograph.operators import graph


def is_thin_page(content: Column) -> Column:
    return F.length(trim_ws(P.after_dashes(content))) < K.THIN_PAGE_CHARS


def catalog_links(catalog: DataFrame) -> DataFrame:
    """(link_text): distinct link targets of the catalog lines."""
    return catalog.select(F.explode(P.link_targets(F.col("line"))).alias("link_text")).distinct()


def missing_from_catalog(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pages whose plain ``[[name]]`` stands nowhere in the catalog, ignoring case.

    Page names hold no brackets, so containing ``[[name]]`` is the same as listing it as a
    bracketed token: an anti-join instead of one substring search per page. The aliased form
    ``[[name|text]]`` does not count.
    """
    listed = catalog.select(
        F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))).alias("key")
    ).distinct()
    names = pages.select("name").distinct().withColumn("key", F.lower("name"))
    return names.join(listed, "key", "left_anti").select("name")


def stale_catalog_links(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog link targets without a page."""
    links = catalog_links(catalog).withColumn("link_key", F.lower("link_text"))
    return links.join(graph.page_keys(pages), "link_key", "left_anti").select(F.col("link_text").alias("target"))


def frontmatter_issues(pages: DataFrame) -> DataFrame:
    """(name, problems) of unique pages with an incomplete front matter."""
    found = graph.unique_pages(pages).select("name", computed(P.frontmatter_problems(F.col("content"))).alias("p"))
    return found.filter(F.size("p") > 0).select("name", F.array_join("p", ", ").alias("problems"))


def thin_pages(pages: DataFrame) -> DataFrame:
    return graph.unique_pages(pages).select("name", computed(is_thin_page(F.col("content"))).alias("thin")).filter("thin").select("name")


def bodyless_pages(pages: DataFrame) -> DataFrame:
    unique = graph.unique_pages(pages)
    judged = unique.select("subdir", "name", computed(P.is_bodyless(F.col("subdir"), F.col("content"))).alias("bodyless"))
    return judged.filter("bodyless").select("subdir", "name")


def page_counts(pages: DataFrame) -> DataFrame:
    """(subdir, n) for all four kinds, zero included, at most four rows."""
    kinds = pages.sparkSession.createDataFrame([(s,) for s in K.SUBDIRS], "subdir string")
    counted = pages.groupBy("subdir").agg(F.count("*").alias("n"))
    return kinds.join(counted, "subdir", "left").select("subdir", F.coalesce("n", F.lit(0)).alias("n"))


def _finding(df: DataFrame, level: str, code: str, page: Column, target: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(level).alias("level"), F.lit(code).alias("code"), page.alias("page"), target.alias("target"), detail.alias("detail")
    )


def page_findings(unique: DataFrame, isolated: bool = True, bodyless: bool = True) -> DataFrame:
    """Findings that one page alone decides, all from a single pass over the page texts."""
    c = F.col("content")
    problems = P.frontmatter_problems(c)
    checks = [
        ("warning", "frontmatter", F.when(F.size(problems) > 0, F.array_join(problems, ", "))),
        ("info", "thin", F.when(is_thin_page(c), "")),
    ]
    if isolated:
        checks.append(("info", "isolated", F.when(F.size(P.link_occurrences(c)) == 0, "")))
    if bodyless:
        checks.append(("warning", "bodyless", F.when(P.is_bodyless(F.col("subdir"), c), "")))
    tested = F.array(
        *[F.struct(F.lit(lv).alias("level"), F.lit(code).alias("code"), detail.alias("detail")) for lv, code, detail in checks]
    )
    rows = unique.select(F.col("name").alias("page"), F.inline(tested)).filter(F.col("detail").isNotNull())
    return rows.select("level", "code", "page", F.lit("").alias("target"), "detail")


def report(pages: DataFrame, catalog: DataFrame | None = None, isolated: bool = True, bodyless: bool = True) -> DataFrame:
    """(level, code, page, target, detail): every finding as one row.

    A broken target is reported once per referring page, so a target half the wiki links to is
    many small rows instead of one endless message.
    """
    none = F.lit("")
    unique = graph.unique_pages(pages)
    parts = [
        _finding(graph.broken_links(unique), "error", "broken_link", F.col("page"), F.col("target"), none),
        _finding(graph.orphans(unique), "warning", "orphan", F.col("name"), none, none),
        page_findings(unique, isolated, bodyless),
    ]
    if catalog is not None:
        parts.append(_finding(stale_catalog_links(pages, catalog), "error", "stale_index", F.lit("index"), F.col("target"), none))
        parts.append(_finding(missing_from_catalog(pages, catalog), "warning", "not_in_index", F.col("name"), none, none))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level", "code").agg(F.count("*").alias("n"))


def broken_targets(pages: DataFrame) -> DataFrame:
    """(target, n_pages, first_page): broken targets with their number of referrers."""
    broken = graph.broken_links(graph.unique_pages(pages))
    return broken.groupBy("target").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"))
