"""Upsert sink, late rows, and sessions with own state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aislemetrics.streaming import events, sessions, upsert

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return events.ingest(spark, folder, SCHEMA, files_per_batch=1)


@pytest.fixture
def arrivals(spark, tmp_path):
    """Five batches; the third and later ones hold rows of the first hours."""
    folder = f"{tmp_path}/arrivals"
    for k in range(5):
        late = [(100 + k, at(0.5), 1, "a", 1.0)] if k in (2, 4) else []
        arrive(spark, folder, [(k, at(k * 10), 1, "a", 1.0), (10 + k, at(k * 10 + 0.2), 2, "b", 2.0), *late])
    return folder


def test_late_rows_are_the_ones_that_totals_leave_out(spark, arrivals, tmp_path):
    totals = events.windowed_totals(source(spark, arrivals), late="1 hour")
    upsert.run_upserts(totals, f"{tmp_path}/up")
    table = upsert.current(spark, f"{tmp_path}/up", totals.schema, ["window_start", "window_end", "event_type"])
    late = upsert.run_late(source(spark, arrivals), f"{tmp_path}/late", F.date_trunc("hour", "ts") + F.expr("interval 1 hour"), "1 hour")
    # before the third batch the watermark had moved by the first one only, to half an hour before its newest time
    assert sorted((r.event_id, r.batch) for r in late.collect()) == [(104, 4)]
    assert table.agg(F.sum("n")).first()[0] + late.count() == 12


def test_a_replayed_batch_changes_nothing(spark, arrivals, tmp_path):
    path, keys = f"{tmp_path}/up", ["window_start", "window_end", "event_type"]
    totals = events.windowed_totals(source(spark, arrivals), late="1 hour")
    upsert.run_upserts(totals, path)
    table = lambda: sorted(map(str, upsert.current(spark, path, totals.schema, keys).collect()))
    before = table()
    again = spark.read.schema(totals.schema).parquet(f"{path}/changes/batch=2")
    rows = spark.createDataFrame(again.collect(), totals.schema)
    for _ in range(2):
        upsert.upsert_batch(rows, 2, path)
    assert table() == before
    upsert.fold(spark, path, totals.schema, keys, 3)
    assert table() == before
    # a later batch still wins over the folded rows, an older one does not
    upsert.upsert_batch(rows.withColumn("n", F.lit(99).cast("long")), 9, path)
    assert sum(r.n == 99 for r in upsert.current(spark, path, totals.schema, keys).collect()) == rows.count()


def test_nothing_upserted(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    assert upsert.current(spark, f"{tmp_path}/none", schema, ["k"]).count() == 0


def test_sessions_end_by_gap_and_by_length(spark, tmp_path):
    sessions.with_state_store(spark)
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    # user 1: out of order within its session; user 2: an event every ten minutes for three hours; users 3 and 4: later
    arrive(spark, folder, [(1, at(0.3), 1, "a", 1.0), (2, at(0), 1, "a", None), (3, at(0.4), None, "a", 9.0)])
    arrive(spark, folder, [(4, at(0.1), 1, "a", 2.0), *[(10 + i, at(i / 6), 2, "a", 1.0) for i in range(19)]])
    arrive(spark, folder, [(5, at(30), 3, "a", 5.0), (6, at(30.2), 3, "a", 5.0)])
    arrive(spark, folder, [(7, at(30.7), 4, "a", 1.0), (8, at(30.9), 4, "a", 1.0)])

    def run():
        stream = sessions.bounded_sessions(source(spark, folder), 30, 120, "5 minutes")
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True)
        query = writer.format("parquet").option("path", f"{tmp_path}/out").start()
        query.awaitTermination()
        return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]

    try:
        sizes = run()
        got = sorted((r.user_id, r.session_start, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got == [(1, at(0), 3, 3.0), (2, at(0), 12, 12.0), (2, at(2), 7, 7.0), (3, at(30), 2, 10.0)]
        still = {r.user_id: (r.session_start, r.n) for r in sessions.open_sessions(spark, state).collect()}
        assert still == {4: (at(30.7), 2)}
        # state of the sessions that ended has gone
        assert sizes[-1] < max(sizes)
        arrive(spark, folder, [(9, at(90), 5, "a", 1.0)])
        run()
        got = sorted((r.user_id, r.session_start, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got[-1] == (4, at(30.7), 2)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
