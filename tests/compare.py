"""Run a registered query on Spark and its oracle on DuckDB and compare all values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from foliograph.sources.derived import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([_norm(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, sf_dir):
    """Return (ok, message)."""
    from foliograph.catalog import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in ORACLES:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no oracle)"
    cur = con.execute(ORACLES[name])
    want = cur.fetchall()
    cols = [c[0] for c in cur.description]
    t2 = time.time()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    msg = f"rows={len(a)}/{len(b)} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s"
    if a != b:
        sa, sb = set(a), set(b)
        msg += f"\n   columns {sorted(cols)}"
        for x in sorted(sa - sb)[:3]:
            msg += f"\n   spark  {x[:700]}"
        for x in sorted(sb - sa)[:3]:
            msg += f"\n   oracle {x[:700]}"
    return a == b, msg


def main(argv):
    from foliograph.catalog import QUERIES
    from foliograph.session import local_session

    sf_dir = argv[0]
    names = [n for n in QUERIES if not argv[1:] or any(n == p or n.startswith(p + "_") for p in argv[1:])]
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the other queries
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n}: {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
