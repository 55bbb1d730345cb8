"""Compare this package's queries with their SQL: python -m aislemetrics.llm.compare FOLDER [name part ...]."""

from __future__ import annotations

import sys
import tempfile
import time

from aislemetrics.llm.queries import ORACLE_SQL, QUERIES
from aislemetrics.session import local_session


def main(argv: list[str]) -> int:
    from workload.compare import connect, rows_of

    spark, bad = local_session("compare", scratch=tempfile.mkdtemp(prefix="compare-")), 0
    for name in [n for n in QUERIES if not argv[1:] or any(a in n for a in argv[1:])]:
        start = time.time()
        df = QUERIES[name](spark, argv[0])
        got, spent = rows_of(df.columns, df.collect()), time.time() - start
        if name not in ORACLE_SQL:
            print(f"rows {name} {len(got[1])} {spent:.1f}s", flush=True)
            continue
        cur = connect(argv[0]).execute(ORACLE_SQL[name])
        want = rows_of([d[0] for d in cur.description], cur.fetchall())
        bad += got != want
        print("ok  " if got == want else "FAIL", name, len(got[1]), len(want[1]), f"{spent:.1f}s {time.time() - start:.1f}s", flush=True)
        if got != want:
            print(got[0], want[0], sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
