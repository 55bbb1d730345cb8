"""Compare registered queries with DuckDB: python -m workload.compare [folder] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
import traceback

import duckdb

from aislemetrics.session import local_session
from workload import QUERIES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else f"{float(value):.9g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, folder, name) -> str:
    q = QUERIES[name]
    start = time.time()
    df = q.run(spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if q.sql is None:
        return f"rows  {name} {len(got[1])} rows {spent:.1f}s"
    cur = con.execute(q.oracle())
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return f"ok    {name} {len(got[1])} rows {spent:.1f}s" + ("" if got[1] else "  EMPTY")
    text = f"FAIL  {name} {spent:.1f}s rows {len(got[1])} vs {len(want[1])}"
    if got[0] != want[0]:
        return text + f"\n   columns {got[0]} vs {want[0]}"
    only_got = sorted(set(got[1]) - set(want[1]))[:3]
    only_want = sorted(set(want[1]) - set(got[1]))[:3]
    return text + f"\n   {got[0]}\n   spark  {only_got}\n   duckdb {only_want}"


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session("compare", scratch=tempfile.mkdtemp(prefix="compare-")), connect(folder)
    names = [n for n in QUERIES if not argv[1:] or any(a in n for a in argv[1:])]
    bad = 0
    for name in names:
        try:
            line = check(spark, con, folder, name)
        except Exception as err:  # noqa: BLE001 - report and go on with the next query
            line = f"ERROR {name} {type(err).__name__} {str(err)[:600]}"
            if "-v" in argv:
                traceback.print_exc()
        bad += line.startswith(("FAIL", "ERROR"))
        print(line, flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
