"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans rely on: AQE re-plans joins from measured sizes (so a side
# is broadcast only after its size was checked) and splits skewed join partitions.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Shuffled page rows grow tenfold when they are read; a task gets few MB of them, however many there are.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Pages of sorted files that hold none of the listed values are not read, also for long lists.
    "spark.sql.parquet.pushdown.inFilterThreshold": "4096",
    # Rows can hold a long text or its words: few at a time from files and to Python.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


SPLIT_BYTES = 2 << 20  # of a stored table whose rows grow into page texts, in a task
SHUFFLE_BYTES = 1 << 20  # of such tables, for each part of a shuffle of the pages' names and links
_SHUFFLE_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else built."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "foliograph", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    A single-machine session without that setting gets a folder of its own; a cluster without it
    is an error, since model calls would otherwise be repeated for every use of their results.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), f"foliograph-{spark.sparkContext.applicationId}")


def is_missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is there; any other failure is no empty table."""
    return error.getCondition() == "PATH_NOT_FOUND"


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on the workers of this session, wherever it was started."""
    context = spark.sparkContext
    if getattr(context, "_foliograph_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="foliograph-"), "foliograph.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(os.path.join(root, "foliograph")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._foliograph_shipped = True


def persist_durably(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading the table back.

    Used for results that are read several times and are either small (ranked hits) or
    expensive (model calls). Lost executors never lose it, and its file size lets Spark
    decide on broadcasting from a measured number.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def grow_shuffles(spark: SparkSession, stored: int) -> None:
    """Let shuffles have as many parts as the stored size asks for, so that what one task aggregates or joins does not grow
    with the tables. AQE puts small parts together again, but never splits those of an aggregate."""
    parts = -(-stored // SHUFFLE_BYTES)
    if parts > int(spark.conf.get(_SHUFFLE_PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_SHUFFLE_PARTS, str(parts))


def spread(df: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Use all cores on an input with fewer splits than cores, and with ``split_bytes`` as many tasks as its stored size asks for."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if split_bytes is not None:
        tasks = max(tasks, -(-stored_bytes(df) // split_bytes))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
