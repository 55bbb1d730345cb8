"""File and catalog scans, table and summary sinks, previews and samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    sep: str = ",",
    header: bool = True,
) -> DataFrame:
    """Delimited text. With a schema, bad fields become NULL; without one, types are inferred."""
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog (Hive) table."""
    return spark.read.table(name)


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order; the scan reads no others."""
    return df.select(*[c for c in wanted if c in df.columns])


def save_table(
    df: DataFrame, name: str, if_exists: str = "replace", partition_by: Sequence[str] = (), path: str | None = None
) -> DataFrame:
    """Write a catalog table: ``replace`` it, ``keep`` an existing one, or ``fail``.

    With ``path`` the table is external and its files live there.
    """
    mode = {"replace": "overwrite", "keep": "ignore", "fail": "errorifexists"}[if_exists]
    writer = df.write.mode(mode)
    writer = writer.option("path", path) if path else writer
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.saveAsTable(name)
    return df.sparkSession.read.table(name)


def bucket_count(rows: int, row_bytes: int, bucket_bytes: int = 256 << 20) -> int:
    """Buckets of about ``bucket_bytes``, as a power of two, so that tables of other sizes can share the layout."""
    return 1 << max(0, (rows * row_bytes // bucket_bytes).bit_length())


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write a catalog table clustered and sorted by ``keys`` in ``buckets`` buckets.

    Tables bucketed alike join on the keys, and fold by them, without an exchange. Rows go to their
    bucket's task once, so a bucket is one file.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer = writer.option("path", path) if path else writer
    writer.saveAsTable(name)
    return df.sparkSession.read.table(name)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a prepared frame cached while several results are taken from it."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def save_summary(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a summary frame (a handful of rows) as one file in ``path``."""
    df.coalesce(1).write.mode("overwrite").format(fmt).save(path)


def preview(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in key order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def _drawn(key: str | Sequence[str], seed: int) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def chart_fraction(df: DataFrame, key: str | Sequence[str], fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """The rows whose key hash is in the first ``fraction`` of all hashes: the same whatever the partitioning.

    ``key`` should be unique, or rows that share it are drawn together.
    """
    return df.where(F.substring(_drawn(key, seed), 1, 8) < f"{min(int(fraction * 2**32), 2**32 - 1):08x}")


def chart_rows(df: DataFrame, key: str | Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order of a unique key: the same rows whatever the partitioning."""
    return df.orderBy(_drawn(key, seed)).limit(n)
