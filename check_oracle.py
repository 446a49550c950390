"""Compare registered queries with their DuckDB twins: ``python check_oracle.py [--sf DIR] [names...]``."""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

from trustframe.registry import all_oracles, all_queries
from trustframe.session import build_session


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return normal(v.item())
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float, bool)) else (False, "", float(x)) for x in t))


def close(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and float(a) == float(b)
    return a == b


def compare(spark, con, sf, name, query, sql):
    t0 = time.time()
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(names)}", t1 - t0, t2 - t1
    if len(got) != len(want):
        return f"FAIL rows {len(got)} vs {len(want)}", t1 - t0, t2 - t1
    a, b = rows_of(got, df.columns), rows_of(want, names)
    bad = [(x, y) for x, y in zip(a, b) if not all(close(p, q) for p, q in zip(x, y))]
    if bad:
        return f"FAIL {len(bad)}/{len(a)} values, first {bad[0]}", t1 - t0, t2 - t1
    return f"ok {len(a)}", t1 - t0, t2 - t1


def force_distributed() -> None:
    """Shrink every block, segment and single-task bound so that test data exercises the large-data plans."""
    from trustframe.operators import cluster, family, pairs, points
    from trustframe.plans import lookup, ranks, scans, tiles

    ranks.SINGLE_TASK_ROWS = 0
    tiles.BLOCK_ROWS, tiles.BLOCK_BYTES = 40, 40_000
    pairs.PASS_PAIRS = 20_000
    scans.SEGMENT, scans.BELIEF_SEGMENT = 16, 16
    lookup.BROADCAST_ROWS = 0
    family.INLINE_VALUES = 0
    points.FRAME_TASK_POINTS = 100
    cluster.SINGLE_TASK_ITEMS = cluster.ROUND_ITEMS = 5
    cluster.CUT_ITEMS = 0


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--distributed", action="store_true", help="force every small-input shortcut off")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    if args.distributed:
        force_distributed()
    spark, con = build_session(), connect(args.sf)
    queries, oracles = all_queries(), all_oracles()
    failed = 0
    for name in args.names or queries:
        try:
            msg, ts, td = compare(spark, con, args.sf, name, queries[name], oracles.get(name))
        except Exception as e:  # report and go on
            msg, ts, td = f"FAIL {type(e).__name__}: {str(e)[:500]}", 0, 0
        failed += msg.startswith("FAIL")
        print(f"{name:28s} spark {ts:6.2f}s duck {td:6.2f}s  {msg}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
