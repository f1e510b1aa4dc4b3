"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("STRICT") == "1"  # exact float equality, no rounding


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def rows_key(r):
    return tuple((x is None, str(type(x)), x) if not isinstance(x, tuple) else (False, "t", str(x)) for x in r)


def compare(spark, con, name, q, sql, sf_dir):
    t0 = time.time()
    sdf = q(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(norm(r[c]) for c in sorted(scols)) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    idx = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = [tuple(norm(r[i]) for i in idx) for r in drows_raw]
    t2 = time.time()
    ok_cols = sorted(scols) == sorted(dcols)
    srows.sort(key=rows_key)
    drows.sort(key=rows_key)
    ok = ok_cols and srows == drows
    msg = f"{'OK ' if ok else 'BAD'} {name:32s} rows {len(srows):6d}/{len(drows):6d} spark {t1 - t0:6.2f}s duck {t2 - t1:6.2f}s"
    if not ok_cols:
        msg += f"\n    cols spark={sorted(scols)}\n         duck={sorted(dcols)}"
    elif not ok:
        diff = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
        msg += f"\n    first diffs: {diff}"
    print(msg, flush=True)
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    import __spark_entry__ as E
    from textbench.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = []
    for name, q in qs.items():
        if only and name not in only:
            continue
        if name not in orc:
            print(f"--  {name} (no oracle)")
            continue
        try:
            if not compare(spark, con, name, q, orc[name], sf_dir):
                bad.append(name)
        except Exception as e:  # report and continue
            print(f"ERR {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
