"""Event-stream operators. All take and return streaming (or batch) DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import coerce_numeric
from ..session import scratch_path


#: Time of the row that ends a finite stream.
END = dt.datetime(2200, 1, 1)


def ingest(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    numeric: Sequence[str] = (),
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """File stream with a fixed schema; listed columns are cast leniently to numbers."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return coerce_numeric(reader.format(fmt).load(path), numeric)


def windowed_totals(
    events: DataFrame,
    length: str = "1 hour",
    slide: str | None = None,
    late: str = "10 minutes",
    by: Sequence[str] = ("event_type",),
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Count and total per (sliding) window and key; rows later than ``late`` are dropped."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, length, slide).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")
    )


def first_seen(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Drop repeats of ``key`` that arrive within the watermark; state is bounded by it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def enrich(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Left join of the stream with a static table on ``key``."""
    return events.join(static, key, "left")


def session_totals(
    events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", user: str = "user_id", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Events and total per user session; a session ends after ``gap`` without events."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), user)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
    )


def run_available(stream: DataFrame) -> DataFrame:
    """Process all data present in append mode (exactly-once file sink) and read the result back."""
    root = scratch_path(stream.sparkSession, "stream")
    return _appended(stream, root)


def _appended(stream: DataFrame, root: str) -> DataFrame:
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def run_closed(source: DataFrame, build: Callable[[DataFrame], DataFrame], start: str, ts: str = "ts") -> DataFrame:
    """Process all data present, and close the windows that are still open at the end of it.

    ``build`` makes windows from ``source`` and is run in append mode, so a window is written once,
    when the watermark passes it, and its state goes. After the last data a second run on the same
    state reads one row far in the future, which moves the watermark past every window; that row's
    own window never closes. ``start``: name of the window's first column.
    """
    spark = source.sparkSession
    root = scratch_path(spark, "stream")
    flush = f"{root}/flush"
    blank = spark.createDataFrame([], source.schema)
    blank.coalesce(1).write.parquet(flush)
    closed = build(source.unionByName(spark.readStream.schema(source.schema).parquet(flush)))
    _appended(closed, root)
    row = {f.name: None for f in source.schema} | {ts: END}
    spark.createDataFrame([tuple(row[f.name] for f in source.schema)], source.schema).coalesce(1).write.mode("append").parquet(flush)
    return _appended(closed, root).where(F.col(start) < F.lit(END) - F.expr("interval 7 days"))
