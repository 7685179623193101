"""Row-for-row comparison of a query with its SQL check in DuckDB, for tests and the command line."""

from __future__ import annotations

import datetime
import decimal
import os
import time

import duckdb

from docspan.plans.inputs import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, fn, sql, con):
    """None when equal, else a short account of the difference; with timings."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    problem = None
    if got_cols != want_cols:
        problem = f"columns {got_cols} against {want_cols}"
    elif got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        problem = f"{len(got)} rows against {len(want)}\n   got only:  {extra}\n   want only: {missing}"
    return problem, len(got), t1 - t0, t2 - t1
