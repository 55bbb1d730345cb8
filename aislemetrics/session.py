"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(
    app: str = "aislemetrics", cpus: str | int = "*", memory: str = "8g", scratch: str | None = None
) -> SparkSession:
    """Single-machine session for tests and the benchmark; ``scratch`` becomes its checkpoint folder."""
    parallel = os.cpu_count() if str(cpus) == "*" else int(cpus)
    if scratch:
        SparkSession.builder.config("spark.checkpoint.dir", scratch)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors must share. Raises if none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the checkpoint folder; what is written there goes when the program ends."""
    path = f"{checkpoint_root(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clear_scratch)
    _scratch.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, through Spark's file systems; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _clear_scratch() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        for spark, path in _scratch:
            remove_path(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder, so that every consumer sees the same rows.

    Needed where a row's physical partition is part of the result (range-partitioned running
    totals): evaluating such a plan twice could draw other range bounds.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the checkpoint folder: compact, and each consumer reads its own columns."""
    path = scratch_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scalar_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery; fields by ``row["name"]``."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row")).scalar()
