"""The gazetteer: tiers, alias index, lookup and promotion of stable pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions import pages as P
from foliograph.functions.text import accepts_type, alias_key, blank, computed, trim_ws
from foliograph.operators.grouping import last_row

ENTRY = ("canonical_name", "canonical_type", "compatible_types", "description", "aliases", "subdir", "tier", "reg_ord")


def _registration(tier: Column, reg_ord: Column) -> Column:
    """Later registrations win; the promoted tier is loaded after the seed tier."""
    return F.struct((tier != "seed").cast("int").alias("tier"), reg_ord.alias("ord"))


def _order(entry: dict[str, Column]) -> list[Column]:
    """What decides between entries of one key; the last one wins."""
    return [entry["tier"] != "seed", entry["reg_ord"], entry["subdir"], entry["canonical_name"], entry["description"]]


def primaries(entries: DataFrame) -> DataFrame:
    """One entry per canonical key (``key`` + entry columns); equal registrations by kind and name."""
    keyed = entries.select(alias_key(F.col("canonical_name")).alias("key"), *ENTRY).filter(F.col("key") != "")
    return last_row(keyed, ["key"], F.struct(_registration(F.col("tier"), F.col("reg_ord")), "subdir", "canonical_name", "description"))


def alias_index(entries: DataFrame) -> DataFrame:
    """(key, primary_key): a canonical key maps to itself, any other alias to its last registration."""
    own = alias_key(F.col("canonical_name"))
    order = _registration(F.col("tier"), F.col("reg_ord"))
    canonical = entries.select(
        own.alias("key"), own.alias("primary_key"), F.lit(1).alias("own"), order.alias("ord"), F.lit(0).alias("pos")
    )
    aliases = entries.select(
        own.alias("primary_key"), order.alias("ord"), F.posexplode("aliases").alias("pos", "alias")
    ).select(alias_key(F.col("alias")).alias("key"), "primary_key", F.lit(0).alias("own"), "ord", "pos")
    rows = canonical.unionByName(aliases).filter((F.col("key") != "") & (F.col("primary_key") != ""))
    return rows.groupBy("key").agg(F.max_by("primary_key", F.struct("own", "ord", "pos")).alias("primary_key"))


def gazetteer(entries: DataFrame) -> DataFrame:
    """Every surface key with the entry it leads to, columns prefixed ``e_``."""
    entry = primaries(entries).select(
        F.col("key").alias("primary_key"), *[F.col(c).alias(f"e_{c}") for c in ENTRY]
    )
    return alias_index(entries).join(entry, "primary_key")


def _with_later(joined: DataFrame, later: DataFrame) -> DataFrame:
    """Rows of ``lookup`` with what entries of earlier files change about them."""

    def candidate(own: Column, prefix: str) -> Column:
        c = {name: F.col(prefix + name) for name in ENTRY}
        order = [own.alias("own"), *_order(c), *[c[n] for n in ("compatible_types", "aliases", "canonical_type")]]
        return F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[c[n].alias(f"e_{n}") for n in ENTRY]).alias("entry"))

    # A key has as many as there are stable pages with that name, whatever stands in their parentheses.
    named = later.select(alias_key(F.col("canonical_name")).alias("surface_key"), "since", candidate(F.lit(True), "").alias("c"))
    by_key = named.filter("surface_key <> ''").groupBy("surface_key").agg(F.collect_list(F.struct("c", "since")).alias("later"))
    seen = F.filter("later", lambda x: x["since"] < F.col("source"))
    newest = F.array_max(F.transform(seen, lambda x: x["c"]))
    own = alias_key(F.col("e_canonical_name")) == F.col("surface_key")
    known = F.when(F.col("e_canonical_name").isNotNull(), candidate(own, "e_"))
    rest = [c for c in joined.columns if c not in [f"e_{n}" for n in ENTRY]]
    best = joined.join(by_key, "surface_key", "left").withColumn("best", F.greatest(known, newest))
    return best.select(*rest, "best.entry.*")


def lookup(items: DataFrame, entries: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """Left join of items (name, type, subdir) to their entry; NULL on a type or kind conflict.

    ``later`` holds entries that count only for items of a ``source`` after their ``since``; none is a seed's.
    """
    surface = gazetteer(entries).withColumnRenamed("key", "surface_key")
    joined = items.withColumn("surface_key", alias_key(F.col("name"))).join(surface, "surface_key", "left")
    if later is not None:
        joined = _with_later(joined, later)
    fits = accepts_type(F.col("e_compatible_types"), F.col("type")) & (
        (blank(F.col("e_subdir")) == "") | (F.col("e_subdir") == F.col("subdir"))
    )
    return joined.select(
        *items.columns, *[F.when(fits, F.col(f"e_{c}")).alias(f"e_{c}") for c in ENTRY]
    )


def promotable(pages: DataFrame, min_sources: int = K.PROMOTE_MIN_SOURCES) -> DataFrame:
    """Entity and concept pages stable enough to become entries (list length counts, repeats included)."""
    c = F.col("content")
    tags = F.transform(F.split(F.regexp_extract(P.frontmatter(c), r"(?m)^tags:[ \t]*\[([^\]]*)\][ \t]*$", 1), ","), trim_ws)
    facts = pages.filter(F.col("subdir").isin("entities", "concepts")).select(
        "subdir", "name",
        computed(F.size(P.anchored_list(c, "sources"))).alias("n_sources"),
        F.lower(F.regexp_replace(F.get(tags, F.lit(0)), "^['\"]+|['\"]+$", "")).alias("canonical_type"),
        P.registry_paragraph(c).alias("paragraph"),
    )
    long = F.left("paragraph", F.lit(K.PROMOTE_MAX_DESC))
    short = F.when(
        F.length("paragraph") > K.PROMOTE_MAX_DESC,
        F.concat(F.regexp_replace(long, r" [^ ]*$", ""), F.lit("...")),
    ).otherwise(F.col("paragraph"))
    bare = trim_ws(F.regexp_replace("name", rf"{K.WS}*\([^)]*\){K.WS}*", " "))
    eligible = facts.filter(
        (F.col("n_sources") >= min_sources) & (F.col("canonical_type") != "") & (F.length("paragraph") >= K.PROMOTE_MIN_DESC)
    )
    return eligible.select(
        F.when(bare == "", F.col("name")).otherwise(bare).alias("canonical_name"),
        "canonical_type",
        F.array("canonical_type").alias("compatible_types"),
        short.alias("description"),
        F.array().cast("array<string>").alias("aliases"),
        "subdir",
        F.lit("promoted").alias("tier"),
        F.col("name").alias("page"),
        "n_sources",
    )


def promote(pages: DataFrame, entries: DataFrame, min_sources: int = K.PROMOTE_MIN_SOURCES) -> DataFrame:
    """Promotable entries that no seed entry already covers."""
    seeds = primaries(entries).filter(F.col("tier") == "seed").select("key")
    new = promotable(pages, min_sources).withColumn("key", alias_key(F.col("canonical_name")))
    return new.join(seeds, "key", "left_anti").drop("key")
