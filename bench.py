"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foliograph.catalog import QUERIES  # noqa: E402
from foliograph.catalog.registry import Tables  # noqa: E402
from foliograph.operators import segments  # noqa: E402
from foliograph.session import local_session  # noqa: E402

HEADLINE = (
    "R5_document_search",
    "R1_document_bm25",
    "R5_stemmed_document_search",
    "R5_search",
    "A7_document_frequency",
    "I7_graph_edges",
    "A4_link_stats",
    "J1_line_link_counts",
    "I6_lint_summary",
    "R9_to_R12_early_stages",
    "D3_survivors",
    "A10_item_fold",
    "T2_content_stems",
    "W4_history_block",
    "W5_tuned_threshold",
)


def stored_index(spark, sf_dir: str) -> dict[str, float]:
    """Build the segmented index of the derived wiki once, then answer a query batch from it."""
    tables = Tables(spark, sf_dir)
    with tempfile.TemporaryDirectory(prefix="foliograph-index-") as path:
        start = time.perf_counter()
        index = segments.SegmentIndex(spark, path)
        index.commit(tables.wiki)
        built = time.perf_counter()
        segments.search(tables.questions, index).write.format("noop").mode("overwrite").save()
        done = time.perf_counter()
    return {"index_build": round(built - start, 3), "indexed_search_25_queries": round(done - built, 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "foliograph-bench", **{"spark.sql.shuffle.partitions": cores if cores.isdigit() else "8"})
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    times.update(stored_index(spark, sf_dir))
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
