"""python -m tests.llm.compare SF_DIR [names]: operator queries against their SQL on DuckDB."""

from __future__ import annotations

import os
import sys
import time

import duckdb

from tests.compare import _rows

NAMES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(spark, sf_dir: str, name: str, query, oracle: str | None) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if oracle is None:
        return True, f"{name}: {len(got)} rows in {took:.1f} s, no oracle; first {got[:2]}"
    cur = connect(sf_dir).execute(oracle)
    want, columns = cur.fetchall(), [c[0] for c in cur.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {df.columns} against {columns}"
    a, b = _rows(df.columns, got), _rows(columns, want)
    message = f"{name}: {len(a)}/{len(b)} rows in {took:.1f} s"
    if a != b:
        for x in sorted(set(a) - set(b))[:3]:
            message += f"\n  spark  {x[:500]}"
        for x in sorted(set(b) - set(a))[:3]:
            message += f"\n  oracle {x[:500]}"
    return a == b, message


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from foliograph.session import local_session

    spark = local_session(8)
    oracles, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if (name.startswith("op") or name == "pipeline") and (not argv[1:] or any(name.startswith(p) for p in argv[1:])):
            ok, message = compare(spark, argv[0], name, query, oracles.get(name))
            bad += not ok
            print("ok  " if ok else "FAIL", message, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
