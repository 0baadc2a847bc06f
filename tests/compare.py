"""Runs queries against their SQL oracles: python tests/compare.py SF NAME..."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    import datetime as dt
    from decimal import Decimal

    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, Decimal)) and v == int(v):
        return int(v)
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, canon(x)) for k, x in sorted(v.items()))
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def oracle(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def compare(spark, sf_dir: str, name: str, query, sql: str | None):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return len(got[1]), None, took, ""
    want = oracle(sql, sf_dir)
    if got == want:
        return len(got[1]), True, took, ""
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return len(got[1]), False, took, f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}\n  only here {sorted(a - b)[:3]}\n  only there {sorted(b - a)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from ledgerloom.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    qs, sql = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(qs)
    for n in [x for x in qs if any(x == n or (n.endswith("*") and x.startswith(n[:-1])) for n in names)]:
        try:
            rows, ok, took, why = compare(spark, f"/root/testdata/{sys.argv[1]}", n, qs[n], sql.get(n))
            print(f"{n}: {rows} rows, {'OK' if ok else 'no oracle' if ok is None else 'DIFFERS'} {took:.1f}s {why}", flush=True)
        except Exception as x:
            print(f"{n}: ERROR {str(x)[:1500]}", flush=True)
