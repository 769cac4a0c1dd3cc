"""Run every registered query against its DuckDB oracle (driver-style check).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from kairos.session import get_session  # noqa: E402
from kairos.sources.tables import DRIVER_TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def key(row):
    return tuple((0, "") if x is None else (1, str(type(x).__name__), x) for x in row)


def compare(spark, con, sf, name, fn, sql):
    t = time.time()
    sdf = fn(spark, sf)
    scols = sdf.columns
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    ts = time.time() - t
    if sql is None:
        return f"{name:22s} rows-only  n={len(srows)} spark={ts:.2f}s"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
    if sorted(scols) != sorted(dcols):
        return f"{name:22s} SCHEMA MISMATCH spark={scols} duck={dcols}"
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    a = sorted((tuple(r[i] for i in order) for r in srows), key=key)
    b = sorted((tuple(r[i] for i in dorder) for r in drows), key=key)
    if a == b:
        return f"{name:22s} OK n={len(a)} spark={ts:.2f}s"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"{name:22s} VALUE MISMATCH ns={len(a)} nd={len(b)} first diffs={diff}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        try:
            msg = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as e:  # report and continue
            msg = f"{name:22s} ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += ("OK" not in msg and "rows-only" not in msg)
        print(msg, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
