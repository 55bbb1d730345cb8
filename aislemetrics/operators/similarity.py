"""Exact similarity join of stores by correlation, pruned by the triangle bound.

Standardised weekly vectors have unit length, so a correlation above t is a distance below
sqrt(2 - 2 t). Every store is measured against a few pivot stores; stores near the same pivot at about
the same distance form a block. Two blocks whose distances to some pivot lie further apart than that
cannot hold a pair, and only the other block pairs are sent to a task and multiplied. The bound never
loses a pair; how many block pairs it saves depends on how the stores cluster.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import numbers_by
from ..functions.columns import has_keys
from ..session import materialize

PIVOTS = 8
RING = 0.1  # width of a block's range of distances to its pivot
BLOCK = 16384  # stores of a block: a task holds two blocks, and a row is sent once per block that its own one meets
TILE = 128  # stores that are compared with a whole block at a time


def standardise(x: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to unit length; NaN rows where constant."""
    c = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    flat = norm <= 1e-12 * np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300) * np.sqrt(x.shape[1])
    return np.where(flat, np.nan, c / np.where(flat, 1.0, norm))


def weekly_lists(df: DataFrame, store: str, week: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, store) with the lists ``_pos``, ``_value`` of its weekly means and ``_weeks``, the number of all weeks."""
    cells = numbers_by(df, [*by, store, week], {"_value": F.avg(value)}).where(F.col("_value").isNotNull())
    weeks = has_keys(df, *by, store, week).where(F.col(value).isNotNull()).select(week).distinct()  # bounded by the calendar
    weeks = weeks.select(week, (F.row_number().over(Window.orderBy(week)) - 1).alias("_pos"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_weeks"))
    # a list of weeks per store, as long as the calendar at most
    return cells.join(F.broadcast(weeks), week).groupBy(*by, store).agg(
        F.collect_list("_pos").alias("_pos"), F.collect_list(F.col("_value").cast("double")).alias("_value"), F.max("_weeks").alias("_weeks")
    )


def dense_rows(batch: pd.DataFrame, missing: float) -> np.ndarray:
    """The lists of :func:`weekly_lists` as a stores x weeks matrix."""
    dense = np.full((len(batch), int(batch["_weeks"].iloc[0])), missing)
    for i, (at, values) in enumerate(zip(batch["_pos"], batch["_value"])):
        dense[i, np.asarray(at)] = values
    return dense


def unit_vectors(df: DataFrame, store: str, week: str, value: str) -> DataFrame:
    """store and ``vec``, the bytes of its standardised weekly means, a missing week being 0. Constant stores are left out."""
    rows = weekly_lists(df, store, week, value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            unit = standardise(dense_rows(batch, 0.0))
            known = ~np.isnan(unit[:, 0])
            yield pd.DataFrame({store: batch[store][known], "vec": pd.Series([u.tobytes() for u in unit[known]], dtype=object, index=batch.index[known])})

    return rows.mapInPandas(run, T.StructType([df.schema[store], T.StructField("vec", T.BinaryType())]))


def _stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def sides_of(batches: Iterator[pd.DataFrame], store: str, first: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Stores and vectors (``vec``) of the block ``first`` and of the other one of a group, None for an empty side."""
    parts: tuple[list, list] = ([], [])
    for batch in batches:
        of_first = (batch["block"] == first).to_numpy()
        for side, rows in zip(parts, (batch[of_first], batch[~of_first])):
            if len(rows):
                side.append((rows[store].to_numpy(), _stack(rows["vec"])))
    return [tuple(np.concatenate(x) for x in zip(*side)) if side else None for side in parts]


def named_pairs(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> pd.DataFrame:
    """store_a < store_b and r."""
    swap = a > b
    return pd.DataFrame({"store_a": np.where(swap, b, a), "store_b": np.where(swap, a, b), "r": r})


def blocks_of(units: DataFrame, store: str, block: int) -> DataFrame:
    """``units`` with ``home``, ``ring`` and ``chunk``, the block, and ``d``, the distances to the pivots."""
    found = units.orderBy(F.xxhash64(store), store).limit(PIVOTS).collect()
    pivots = np.stack([np.frombuffer(bytes(r["vec"])) for r in found]) if found else np.zeros((1, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (_stack(batch["vec"]) @ pivots.T)))
                home = d.argmin(axis=1)
                yield batch.assign(home=home, ring=(d.min(axis=1) / RING).astype(int), d=list(d))

    shape = T.StructType([*units.schema.fields]).add("home", T.IntegerType()).add("ring", T.IntegerType()).add("d", T.ArrayType(T.DoubleType()))
    placed = units.mapInPandas(run, shape)
    chunks = placed.groupBy("home", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    return placed.join(chunks, ["home", "ring"]).withColumn("chunk", F.pmod(F.xxhash64(store), "chunks").cast("int")).drop("chunks")


def block_pairs(placed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The blocks, numbered, and the pairs (a, b) of them, a <= b, that may hold a pair of stores."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7
    places = range(PIVOTS)
    ends = [f(F.get("d", F.lit(i))).alias(f"{n}{i}") for i in places for n, f in (("lo", F.min), ("hi", F.max))]
    blocks = materialize(placed.groupBy("home", "ring", "chunk").agg(*ends).withColumn("block", F.monotonically_increasing_id()))
    width = max(reach, 0.01)

    def bins(more: int):
        low, high = F.floor(F.col("lo0") / width) - more, F.floor(F.col("hi0") / width) + more
        return F.explode(F.sequence(low, high)).alias("bin")

    left = blocks.select(F.col("block").alias("a"), *[F.col(f"{n}{i}").alias(f"a{n}{i}") for i in places for n in ("lo", "hi")], bins(1))
    right = blocks.select(F.col("block").alias("b"), *[f"{n}{i}" for i in places for n in ("lo", "hi")], bins(0))
    near = F.col("a") <= F.col("b")
    for i in places:
        apart = F.greatest(F.col(f"alo{i}") - F.col(f"hi{i}"), F.col(f"lo{i}") - F.col(f"ahi{i}"))
        near &= F.coalesce(apart <= reach, F.lit(True))
    return blocks, left.join(right, "bin").where(near).select("a", "b").distinct()


def correlated_pairs(df: DataFrame, store: str, week: str, value: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """store_a < store_b and r of all pairs with a correlation of weekly means above ``threshold``."""
    df = has_keys(df, store, week)
    placed = materialize(blocks_of(materialize(unit_vectors(df, store, week, value)), store, block))
    blocks, pairs = block_pairs(placed, threshold)
    pairs = materialize(pairs)
    sides = pairs.select(F.col("a").alias("block"), "a", "b").unionByName(pairs.where("a < b").select(F.col("b").alias("block"), "a", "b"))
    rows = placed.join(blocks.select("home", "ring", "chunk", "block"), ["home", "ring", "chunk"]).select(store, "vec", "block")
    kind = df.schema[store].dataType
    out = T.StructType([T.StructField("store_a", kind), T.StructField("store_b", kind), T.StructField("r", T.DoubleType())])

    def kernel(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = sides_of(batches, store, key[0])
        same = key[0] == key[1]
        right = left if same else right
        for start in range(0, len(left[0]), TILE):
            r = left[1][start : start + TILE] @ right[1].T
            keep = r > threshold
            if same:
                keep &= np.arange(len(right[0])) > np.arange(start, start + len(r))[:, None]
            i, j = np.nonzero(keep)
            yield named_pairs(left[0][start + i], right[0][j], r[i, j])

    return rows.join(sides, "block").groupBy("a", "b").applyInPandas(kernel, out)
