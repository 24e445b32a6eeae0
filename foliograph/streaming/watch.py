"""Folder watch: arriving files are ingested as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliograph.operators import lint
from foliograph.plans.ingest import ingest
from foliograph.session import persist_durably
from foliograph.sources import raw
from foliograph.sources.store import WikiStore


def watch(
    spark: SparkSession, folder: str, store: WikiStore, checkpoint: str, day: str, model=None, use_embeddings: bool = False,
    files_per_batch: int = 1, on_lint: Callable[[DataFrame], None] | None = None, once: bool = False,
    on_failed: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Ingest every file that arrives in ``folder``, optionally linting after each batch.

    The checkpoint remembers seen files; a replayed batch is harmless because unchanged content
    is skipped by its hash. Files that failed are kept in the store and tried again, as they are then, when
    the watch starts and with every batch; ``on_failed`` gets the reasons. One writer per store.
    """

    def failed() -> DataFrame:
        names = store.read().failed.select("filename")
        return raw.read_raw(spark, folder).join(names, "filename", "left_semi")

    def ingest_batch(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        again = failed().join(batch.select("filename"), "filename", "left_anti")
        files = persist_durably(batch.unionByName(again), "arrivals")
        store.write(ingest(store.read(), files, day, model, use_embeddings=use_embeddings, on_failed=on_failed))
        if on_lint is not None:
            current = store.read()
            on_lint(lint.report(current.pages, current.catalog))

    if not store.read().failed.isEmpty():
        store.write(ingest(store.read(), persist_durably(failed(), "arrivals"), day, model, use_embeddings=use_embeddings, on_failed=on_failed))
    arrivals = raw.stream_raw(spark, folder, files_per_batch)
    writer = arrivals.writeStream.foreachBatch(ingest_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")
    return writer.start()
