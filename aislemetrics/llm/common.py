"""Helpers the operators share: reading, text normal forms, lineage cuts, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetrics.session import materialize, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BROADCAST_BYTES = 32 << 20  # a side is broadcast only when its measured size is below this


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its own names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder: compact, and columns can be read alone."""
    folder = scratch_path(df.sparkSession, "tables")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def by_key(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that arrive sorted by ``keys``."""
    parts: list[pd.DataFrame] = []  # of the group that is not ended; put together once, at its end

    def whole() -> pd.DataFrame:
        return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)

    for batch in batches:
        if not len(batch):
            continue
        cuts = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            cuts[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(cuts).tolist()]
        if parts and any(parts[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys):
            yield whole()
            parts = []
        for start, end in zip(bounds, bounds[1:]):
            parts.append(batch.iloc[start:end])
            yield whole()
            parts = []
        parts.append(batch.iloc[bounds[-1] :])
    if parts:
        yield whole()


def _sorted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A sort-merge join: loops would fill the driver with broadcast tables, and adaptive execution splits hot keys."""
    return left.join(right.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): root is the smallest id of its component.

    Links point from larger to smaller ids, and two steps alternate: each link's lower end moves on to
    the smallest id that it is linked to itself (large star), then all lower ends of a node are linked
    to the smallest of them (small star). The links end as stars around the roots, after a number of
    rounds that grows with the logarithm of the longest chain. A step is one join of written tables.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    links = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        least = links.groupBy("hi").agg(F.min("lo").alias("least"))
        moved = _sorted_join(links, least.withColumnRenamed("hi", "lo"), "lo", "left")
        links = materialize(moved.select("hi", F.coalesce("least", "lo").alias("lo")).distinct())
        least = links.groupBy("hi").agg(F.min("lo").alias("least"))
        sides = _sorted_join(links, least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).filter("hi <> lo")
        links = materialize(sides.unionByName(least.withColumnRenamed("least", "lo")).distinct())
    stars = links.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return stars.unionByName(links.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
