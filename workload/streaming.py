"""Stream queries: each runs a stream over the whole event table and is checked as a batch."""

from pyspark.sql import functions as F

from aislemetrics.session import scratch_path
from aislemetrics.streaming import events, sessions, upsert
from workload.registry import query

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(v):
    # a glob, because the stream source takes a folder or a glob and the table may be one file
    return events.ingest(v.spark, f"{v.folder}/events.parque[t]", SCHEMA, ["value"])


LATE = "3 days"  # longest delay of an event in ``delayed``
PARTS = 5


_arrivals: dict[tuple, str] = {}


def delayed(v, parts=PARTS, step=1):
    """The event table as files that arrive one by one, every tenth event up to two times ``step`` days late.

    Four files at a time are written in the order of arrival; each micro-batch takes four. They are
    written once in a session, so that a repeated query does not measure it.
    """
    key = (v.spark.sparkContext.applicationId, v.folder, parts, step)
    if key not in _arrivals:
        folder = scratch_path(v.spark, "arrivals")
        rows = v.spark.read.schema(SCHEMA).parquet(f"{v.folder}/events.parquet")
        arrives = F.col("ts") + F.expr(f"make_interval(0, 0, 0, if(event_id % 10 = 0, cast(event_id % 3 as int) * {step}, 0))")
        seconds = arrives.cast("double")
        low, high = rows.agg(F.min(seconds), F.max(seconds)).first()
        part = F.floor((seconds - low) / max(1.0, high - low + 1) * parts)
        for k in range(parts):
            rows.where(part == k).repartition(4).write.mode("append").parquet(folder)
        _arrivals[key] = folder
    return events.ingest(v.spark, _arrivals[key], SCHEMA, ["value"], files_per_batch=4)


query("stream_ingest", "L1", "select event_id, user_id, event_type, value from events")(
    lambda v: events.run_available(stream(v).select("event_id", "user_id", "event_type", "value"))
)
query(
    "stream_hourly_totals",
    "L2",
    "select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, event_type, "
    "count(*) as n, sum(value) as total from events group by 1, 2, 3",
    "total:2",
)(lambda v: events.run_closed(delayed(v), lambda e: events.windowed_totals(e, late=LATE), "window_start"))
query(
    "stream_sliding_totals",
    "L2",
    "select s as window_start, s + interval 2 hour as window_end, event_type, count(*) as n, sum(value) as total from "
    "(select *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as s from events) group by 1, 2, 3",
    "total:2",
)(lambda v: events.run_closed(delayed(v), lambda e: events.windowed_totals(e, "2 hours", "1 hour", late=LATE), "window_start"))
query("stream_first_seen", "L3", "select distinct event_id, event_type, value from events")(
    lambda v: events.run_available(
        events.first_seen(stream(v).unionByName(stream(v))).select("event_id", "event_type", "value")
    )
)
query(
    "stream_enriched",
    "L4 B14",
    "select event_id, value, base_unit_retail_amt, value - base_unit_retail_amt as gap from events e left join catalog c on e.user_id = c.item_nbr",
    "gap:6",
)(
    lambda v: events.run_available(
        events.enrich(
            stream(v).withColumnRenamed("user_id", "item_nbr"),
            v.catalog.select("item_nbr", "base_unit_retail_amt"),
            "item_nbr",
        ).select("event_id", "value", "base_unit_retail_amt", (F.col("value") - F.col("base_unit_retail_amt")).alias("gap"))
    )
)
query(
    "stream_session_totals",
    "L5",
    "select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n, sum(value) as total from ("
    "select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from (select *, case when "
    "ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh "
    "from events)) group by user_id, session",
    "total:2",
)(lambda v: events.run_closed(delayed(v), lambda e: events.session_totals(e, late=LATE), "session_start"))


# ---- update mode with late rows -------------------------------------------------
# Eight micro-batches, every tenth event up to eight days late, and a watermark of one hour: a batch drops
# what ended before the newest time of the batches before the last one, less the hour.
UPSERT_PARTS, STEP, SHORT = 8, 4, "1 hour"
WINDOW_KEYS = ["window_start", "window_end", "event_type"]
MARKED = f"""
with a as (select *, epoch(ts + to_days(case when event_id % 10 = 0 then cast(event_id % 3 as int) * {STEP} else 0 end)) as s from events),
p as (select *, floor((s - min(s) over ()) / greatest(1e0, max(s) over () - min(s) over () + 1) * {UPSERT_PARTS}) as part from a),
w as (select part, max(ts) as newest from p group by part),
m as (select p.*, date_trunc('hour', ts) as window_start, (select max(newest) from w where w.part < p.part - 1) - interval {SHORT} as mark from p)"""
LATE_IF = "coalesce(window_start + interval 1 hour <= mark, false)"


def arriving(v):
    return delayed(v, UPSERT_PARTS, STEP)


def upserted(v):
    totals = events.windowed_totals(arriving(v), late=SHORT)
    path = scratch_path(v.spark, "upserts")
    upsert.run_upserts(totals, path)
    return upsert.current(v.spark, path, totals.schema, WINDOW_KEYS)


query(
    "stream_upserted_totals",
    "L2 L5",
    f"select * from ({MARKED} select window_start, window_start + interval 1 hour as window_end, event_type, count(*) as n, "
    f"sum(value) as total from m where not {LATE_IF} group by 1, 2, 3)",
    "total:2",
)(upserted)
query(
    "stream_late_rows",
    "L2 L5",
    f"select * from ({MARKED} select event_id, ts, event_type, value, cast(part as bigint) as batch from m where {LATE_IF})",
)(
    lambda v: upsert.run_late(
        arriving(v), scratch_path(v.spark, "late"), F.date_trunc("hour", "ts") + F.expr("interval 1 hour"), SHORT
    ).select("event_id", "ts", "event_type", "value", "batch")
)


def bounded(v):
    sessions.with_state_store(v.spark)
    try:
        return events.run_closed(delayed(v), lambda e: sessions.bounded_sessions(e, 600, 2400, LATE), "session_start")
    finally:
        v.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# a session of at most 40 hours that ends after ten hours without an event
query(
    "stream_bounded_sessions",
    "L5",
    "select * from (with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) as i from events where user_id is not null), "
    "w as (select user_id, i, ts, value, ts as start from e where i = 1 union all "
    "select e.user_id, e.i, e.ts, e.value, case when e.ts >= w.ts + interval 10 hour or e.ts >= w.start + interval 40 hour then e.ts else w.start end "
    "from w join e on e.user_id = w.user_id and e.i = w.i + 1) "
    "select user_id, start as session_start, max(ts) as session_end, count(*) as n, coalesce(sum(value), 0) as total from w group by 1, 2)",
    "total:2",
)(bounded)
