"""Group-wise building blocks that never gather an unbounded group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.text import computed

# Spark limits each map task to k rows per group before the shuffle up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold).
_MAP_SIDE_LIMIT = 1000


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", salts: int = 256) -> DataFrame:
    """The first ``k`` rows of every group under a total order, ranked 1..k.

    Small ``k``: the ranked filter is applied inside every map task before the shuffle, so a
    hot group sends at most k rows per task. Larger ``k``: rows are first ranked inside salted
    slices of their group; a group's best k rows are among its slices' best k.
    """
    cut = df
    if k > _MAP_SIDE_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        cut = salted.withColumn("_slice", F.row_number().over(inner)).filter(F.col("_slice") <= k).drop("_salt", "_slice")
    outer = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)


def first_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the smallest ``order``, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the largest ``order`` (a later write replaces an earlier)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which rows with a NULL in a key, which match nothing, do not all go to one task: they are dealt by
    their texts and numbers."""
    plain = [F.col(c) for c, kind in left.dtypes if kind in ("string", "bigint", "int") and c not in keys]
    no_key = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0
    dealt = left.withColumn("_deal", F.when(no_key, F.xxhash64(*plain) if plain else F.lit(0).cast("long")).otherwise(F.lit(0).cast("long")))
    return dealt.join(right.withColumn("_deal", computed(F.lit(0).cast("long"))), [*keys, "_deal"], "left").drop("_deal")
