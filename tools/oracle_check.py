"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [--sf DIR] [key ...]

Compares row count, column names and an order-insensitive hash of the values
(floats rounded to 6 digits), like the driver's correctness gate.
"""

from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

from pickwise.plans.registry import all_queries  # noqa: E402
from pickwise.sources.fixtures import BASE_TABLES  # noqa: E402
from pickwise.session import local_session  # noqa: E402


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return "NULL"
        r = round(float(v), 6)
        return repr(0.0 if r == 0 else r)
    if isinstance(v, (bool, np.bool_)):
        return str(int(v))
    if isinstance(v, (int, np.integer)):
        return repr(float(v)) if False else str(int(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def table_hash(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()

    spark = local_session(8)
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")

    qs = all_queries()
    keys = args.keys or sorted(qs)
    bad = 0
    for key in keys:
        q = qs[key]
        t0 = time.time()
        try:
            sdf = q.build(spark, args.sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL  {key}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"rows  {key}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.execute(q.sql)
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL  {key}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"columns spark={sorted(scols)} duck={sorted(dcols)}")
        if len(srows) != len(drows):
            problems.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not problems:
            hs, ls = table_hash(scols, srows)
            hd, ld = table_hash(dcols, drows)
            if hs != hd:
                diff = [(a, b) for a, b in zip(ls, ld) if a != b][:3]
                problems.append(f"values differ, e.g. {diff}")
        if problems:
            bad += 1
            print(f"FAIL  {key}: " + "; ".join(problems))
        else:
            print(f"ok    {key}: {len(srows)} rows {ts:.1f}s")
        if args.show:
            print("   spark:", srows[:3])
            print("   duck :", drows[:3])
    print(f"{len(keys) - bad}/{len(keys)} passed")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
