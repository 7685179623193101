"""Compare queries with their SQL checks: tools/compare.py [-s 0.001] [name …]"""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docspan.plans.catalog import oracle_sql, queries  # noqa: E402
from docspan.plans.compare import compare, duck  # noqa: E402
from docspan.session import local_session  # noqa: E402

ap = argparse.ArgumentParser()
ap.add_argument("-s", default="0.001")
ap.add_argument("-m", default=None, help="only queries of this plans module")
ap.add_argument("names", nargs="*")
a = ap.parse_args()
sf_dir = f"/root/testdata/sf{a.s}"
spark, con = local_session(), duck(sf_dir)
qs, sqls = queries(), oracle_sql()
names = a.names or list(qs)
if a.m:
    import importlib

    names = list(importlib.import_module(f"docspan.plans.{a.m}").QUERIES)
bad = 0
for n in names:
    try:
        problem, rows, ts, td = compare(spark, sf_dir, n, qs[n], sqls.get(n), con)
    except Exception as e:  # noqa: BLE001 - report and go on
        problem, rows, ts, td = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0, 0
    bad += problem is not None
    print(f"{'ok  ' if problem is None else 'FAIL'} {n}: {rows} rows, spark {ts:.2f}s, duckdb {td:.2f}s{'' if n in sqls else ' (no SQL)'}", flush=True)
    if problem:
        print("   ", problem, flush=True)
print(f"{len(names) - bad} of {len(names)} equal")
sys.exit(bad > 0)
