"""Helpers shared by the operators: words, case folding and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster built-in, with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def space_words(text: Column) -> Column:
    """Maximal runs of other than white space, in order; null and blank texts have none."""
    parts = F.split(F.btrim(text, F.lit(SPACES)), SPACE_CLASS)
    return F.when(F.btrim(text, F.lit(SPACES)) == "", F.array().cast("array<string>")).otherwise(parts)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets one of its own;
    a cluster without the setting is an error, because executors could not share the files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = tempfile.mkdtemp(prefix="foliograph-shared-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: it is computed once,
    survives lost executors, and joins know its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 1024):
    """Arrow batches in slices: what a task holds at a time is bounded by few texts. Memory that
    was freed goes back to the system between batches."""
    import pyarrow as pa

    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
        pa.default_memory_pool().release_unused()


def packed(docs: DataFrame, drop: str | tuple[str | None, ...] | None, *columns: Column) -> DataFrame:
    """{doc: all columns but `drop`, and the given ones}. The row lies inside another struct, so no column
    name can clash and no column is needed; unpacked() takes it out again."""
    names = [c for c in docs.columns if c not in (drop if isinstance(drop, tuple) else (drop,))]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("int")
    return docs.select(F.struct(row.alias("row"), F.lit(0).alias("filled")).alias("doc"), *columns)


def unpacked(df: DataFrame) -> DataFrame:
    return df.withColumn("doc", F.col("doc.row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(key: Column, n: int, most: int) -> Column:
    """Whether a key is among about `most` of n, chosen by hash."""
    return F.lit(True) if n <= most else F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * most / n)


def bounded_labels(labels: DataFrame, id_col: str, label_col: str, most: int, combine) -> DataFrame:
    """(_id, _label) of the ids with a label 0 or 1; about `most` of them, chosen by hash, if there
    are more. The table's size has that bound, so it is marked for broadcast: labelled texts are
    found without shuffling any text."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(
        combine(F.col(label_col)).alias("_label")
    )
    return F.broadcast(known.filter(sampled(F.col("_id"), known.count(), most)))
