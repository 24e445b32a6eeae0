"""JSON sidecar files of a wiki: registry tiers, judge and embedding caches, calibration samples.

A missing file and corrupt content read as empty; a read that fails otherwise is an error.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions.text import blank, trim_ws
from foliograph.session import is_missing_path

_ENTRY = (
    "struct<canonical_name:string,canonical_type:string,compatible_types:array<string>,"
    "description:string,aliases:array<string>,subdir:string>"
)


def _text(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return spark.createDataFrame([], "value string")


def read_registry(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """Registry entries of one tier; ``entries`` may be a list or an object of entries."""
    raw = _text(spark, path).filter(F.try_parse_json("value").isNotNull())
    listed = F.from_json("value", f"struct<entries:array<{_ENTRY}>>")["entries"]
    mapped = F.map_values(F.from_json("value", f"struct<entries:map<string,{_ENTRY}>>")["entries"])
    rows = raw.select(F.posexplode(F.coalesce(listed, mapped)).alias("reg_ord", "e"))
    none = F.array().cast("array<string>")

    def kept(c):
        return F.filter(F.coalesce(c, none), lambda x: x.isNotNull() & (trim_ws(x) != ""))

    entries = rows.select(
        trim_ws(blank(F.col("e.canonical_name"))).alias("canonical_name"),
        F.lower(trim_ws(blank(F.col("e.canonical_type")))).alias("canonical_type"),
        F.transform(kept(F.col("e.compatible_types")), F.lower).alias("compatible_types"),
        trim_ws(blank(F.col("e.description"))).alias("description"),
        kept(F.col("e.aliases")).alias("aliases"),
        F.lower(trim_ws(F.coalesce("e.subdir", F.lit("entities")))).alias("subdir"),
        F.lit(tier).alias("tier"),
        F.col("reg_ord").cast("long").alias("reg_ord"),
    )
    return entries.filter(F.col("canonical_name") != "")


def read_judge_cache(spark: SparkSession, path: str) -> DataFrame:
    return _text(spark, path).select(
        F.explode(F.from_json("value", "map<string,boolean>")).alias("key", "verdict")
    )


def read_embed_cache(spark: SparkSession, path: str) -> DataFrame:
    rows = _text(spark, path).select(F.explode(F.from_json("value", "map<string,array<float>>")).alias("key", "vector"))
    return rows.filter(F.size("vector") > 0)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    rows = _text(spark, path).select(F.inline(F.from_json("value", "array<struct<cosine:double,same:boolean>>")))
    return rows.filter(F.col("cosine").isNotNull())


def write_registry(entries: DataFrame, path: str) -> None:
    """Promoted entries as JSON lines; the seed tier is never written back."""
    entries.filter(F.col("tier") == "promoted").write.mode("overwrite").json(path)
