"""Bounded sessions whose users share slots of state."""

import datetime as dt
import random

import pytest

from aislemetrics.streaming import events, sessions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, value double"
BIG = (1 << 60) + 1  # an id that floats cannot hold


def brute(rows, gap, longest):
    out, open_ = [], {}
    for ts, user, value in sorted((r[1], r[2], r[3] or 0.0) for r in rows if r[2] is not None):
        s = open_.get(user)
        if s is None or ts >= s[2] + gap or ts >= s[1] + longest:
            s = open_[user] = [user, ts, ts, 0, 0.0]
            out.append(s)
        s[2], s[3], s[4] = ts, s[3] + 1, s[4] + value
    return sorted(map(tuple, out))


def test_many_users_in_few_slots(spark, tmp_path):
    rnd, folder, rows = random.Random(5), f"{tmp_path}/in", []
    for k in range(4):  # every batch reaches an hour into the one before; null and repeated rows
        part = [
            (i, T0 + dt.timedelta(minutes=300 * k + rnd.randrange(-60, 300)), rnd.choice([*range(100), BIG, BIG + 1, None]), rnd.choice([None, 1.0, 2.5]))
            for i in range(1500)
        ]
        part += part[:50]
        rows += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    gap, longest = dt.timedelta(minutes=30), dt.timedelta(minutes=90)
    sessions.with_state_store(spark)
    try:
        source = events.ingest(spark, folder, SCHEMA, files_per_batch=1)
        got = events.run_closed(source, lambda e: sessions.bounded_sessions(e, 30, 90, "2 hours", slots=3), "session_start").collect()
        assert sorted((r.user_id, r.session_start, r.session_end, r.n, r.total) for r in got) == brute(rows, gap, longest)
        # the state has a few rows a slot, however many users there are
        stream = sessions.bounded_sessions(source, 30, 90, "2 hours", slots=3)
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        query.awaitTermination()
        assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 3 * 10
        still = sessions.open_sessions(spark, f"{tmp_path}/state").collect()
        assert {BIG, BIG + 1} <= {r.user_id for r in still} and sum(r.n for r in still) > 0
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("rows", [[], [(1, 0, 5, 2, 1.0), (1, 9, 9, 1, 1.0), (1, 12, 12, 1, 1.0), (2, 12, 12, 1, 3.0)]])
def test_open_sessions_go_on(rows):
    import numpy as np

    columns = [np.array([r[i] for r in rows], "float64" if i == 4 else "int64") for i in range(5)]
    got = [tuple(x) for x in zip(*(c.tolist() for c in sessions.folded(*columns, 6, 10)))]
    assert got == ([(1, 0, 9, 3, 2.0), (1, 12, 12, 1, 1.0), (2, 12, 12, 1, 3.0)] if rows else [])
