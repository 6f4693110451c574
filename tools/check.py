"""Run named queries and compare them with their SQL statement in an in-process DuckDB.

Usage: python tools/check.py [--sf DIR] [--of MODULES] [key ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(int(v))
        return repr(v) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, query, sf_dir):
    """(ok, message) for one registered query."""
    df = query.run(spark, sf_dir)
    got, names = canonical([tuple(r) for r in df.collect()], df.columns)
    if query.sql is None:
        return False, f"rows={len(got)}, no statement"
    rel = con.sql(query.statement())
    want, want_names = canonical(rel.fetchall(), rel.columns)
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if got == want:
        return (True, f"rows={len(got)}") if got else (False, "rows=0 EMPTY")
    gs, ws = set(got), set(want)
    diff = [f"only spark {x}" for x in sorted(gs - ws)[:3]] + [f"only sql   {x}" for x in sorted(ws - gs)[:3]]
    return False, f"rows {len(got)} vs {len(want)}, differing {len(gs - ws)}/{len(ws - gs)} {names}\n   " + "\n   ".join(diff)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--of", help="only keys defined in these catalog modules")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    from gridtide.session import build_session

    from gridtide.catalog import REGISTRY as registered

    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    if args.of:
        args.keys = [k for k, q in registered.items() if q.build.__module__.rsplit(".", 1)[1] in args.of.split(",")]
    bad = 0
    for key in args.keys or list(registered):
        start = time.time()
        try:
            ok, msg = compare(spark, con, registered[key], args.sf)
        except Exception as exc:  # report and go on with the next key
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        if not ok or "EMPTY" in msg or time.time() - start > 8:
            print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - start:.1f}s {msg}", flush=True)
    print(f"checked {len(args.keys or registered)} failed {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
