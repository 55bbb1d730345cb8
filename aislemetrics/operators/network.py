"""Correlation between stores, over weekly means.

A store is one row: the bytes of its W weekly values, NaN where it has none. Stores are hashed into
blocks of at most about ``block`` stores; each pair of blocks is one task that correlates a few stores
at a time with a whole block. The shuffle carries stores x weeks x blocks numbers, not stores squared,
and no group grows with the data: it holds two blocks of W weeks. Only :func:`store_correlations`
and :func:`similar_pairs` return pairs, tile by tile; the others reduce to one row per store inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import numbers_by
from ..session import materialize, scalar_row
from .series import both_ends
from .similarity import BLOCK, TILE, correlated_pairs, dense_rows, named_pairs, sides_of, standardise, weekly_lists

SMALL = 256  # stores of a block that is not split further
SPREAD = 8  # blocks of a group whatever its size, if they are not small: 36 tasks


def _prepared(x: np.ndarray, fill_zero: bool) -> tuple[np.ndarray, ...]:
    """What :func:`_correlate` needs of each row."""
    if fill_zero:
        return (standardise(np.nan_to_num(x)),)
    known = ~np.isnan(x)
    a = np.where(known, x - np.nanmean(x, axis=1, keepdims=True), 0.0)
    return a, known.astype(float), a * a


def _correlate(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> np.ndarray:
    """Correlation of every prepared row of ``left`` with every one of ``right``."""
    if len(left) == 1:
        return left[0] @ right[0].T
    (a, fx, aa), (b, fy, bb) = left, right
    with np.errstate(divide="ignore", invalid="ignore"):
        n = fx @ fy.T
        sx, sy = a @ fy.T, fx @ b.T
        sxx, syy = aa @ fy.T, fx @ bb.T
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = (a @ b.T - sx * sy / n) / np.sqrt(vx * vy)
    flat = (n < 2) | (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)
    return np.where(flat, np.nan, r)


def _tiles(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of ``left``, a few at a time, and their correlations with all rows of ``right``."""
    for start in range(0, len(left[0]), TILE):
        r = _correlate([x[start : start + TILE] for x in left], right)
        yield np.arange(start, start + len(r)), r


def _vectors(df: DataFrame, store: str, week: str, value: str, by: Sequence[str]) -> DataFrame:
    """(by, store) and ``vec``, the bytes of its weekly means, NaN where there is none."""
    rows = weekly_lists(df, store, week, value, by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vec = pd.Series([v.tobytes() for v in dense_rows(batch, np.nan)], dtype=object, index=batch.index)
                yield batch[[*by, store]].assign(vec=vec)

    return rows.mapInPandas(run, T.StructType([*[rows.schema[k] for k in (*by, store)], T.StructField("vec", T.BinaryType())]))


def _block_pairs(df: DataFrame, store: str, week: str, value: str, by: Sequence[str], block: int) -> DataFrame:
    """Weekly vectors with their block, copied to each block pair (lo, hi) that needs them."""
    rows = materialize(_vectors(df, store, week, value, by))
    stores = F.count(F.lit(1))
    needed = F.greatest(F.lit(1), F.ceil(stores / block), F.least(F.lit(SPREAD), F.ceil(stores / SMALL))).cast("int")
    if by:  # blocks of the group's own stores
        rows = rows.join(rows.groupBy(*by).agg(needed.alias("_blocks")), list(by))
    else:
        rows = rows.withColumn("_blocks", rows.agg(needed.alias("n")).scalar())
    rows = rows.withColumn("block", F.pmod(F.xxhash64(store), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select(*by, store, "vec", "block", F.least("block", "_other").alias("_lo"), F.greatest("block", "_other").alias("_hi"))


def _both_sides(key: tuple, batches: Iterator[pd.DataFrame], store: str):
    """Stores and values of the two blocks of a group, and whether they are the same block."""
    lo, hi = key[-2:]
    left, right = sides_of(batches, store, lo)
    return (left, left, True) if lo == hi else (left, right, False)


def _pairs(df, store, week, value, by, fill_zero, above, block) -> DataFrame:
    kind = df.schema[store].dataType
    out = T.StructType(
        [df.schema[k] for k in by]
        + [T.StructField("store_a", kind), T.StructField("store_b", kind), T.StructField("r", T.DoubleType())]
    )

    def kernel(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, same = _both_sides(key, batches, store)
        if left is None or right is None:
            return
        x = _prepared(left[1], fill_zero)
        y = x if same else _prepared(right[1], fill_zero)
        for rows, r in _tiles(x, y):
            keep = np.arange(len(right[0])) > rows[:, None] if same else np.ones(r.shape, bool)
            if above is not None:
                keep &= np.nan_to_num(r, nan=-2.0) > above
            i, j = np.nonzero(keep)
            found = named_pairs(left[0][rows[i]], right[0][j], r[i, j])
            for k, v in zip(reversed(by), reversed(key[:-2])):
                found.insert(0, k, v)
            yield found

    cells = _block_pairs(df, store, week, value, by, block)
    return cells.groupBy(*by, "_lo", "_hi").applyInPandas(kernel, out)


class _Reduced:
    """Sum, count, extremes of the correlations of a block's stores, and how many exceed ``above``."""

    def __init__(self, n: int, above: float):
        self.above, self.own = above, np.zeros(n, int)
        self.sum, self.max, self.min = np.zeros(n), np.full(n, -np.inf), np.full(n, np.inf)
        self.known, self.exceeding = np.zeros(n, int), np.zeros(n, int)

    def add(self, at: np.ndarray | slice, r: np.ndarray, axis: int) -> None:
        known = ~np.isnan(r)
        self.sum[at] += np.where(known, r, 0.0).sum(axis=axis)
        self.max[at] = np.maximum(self.max[at], np.where(known, r, -np.inf).max(axis=axis, initial=-np.inf))
        self.min[at] = np.minimum(self.min[at], np.where(known, r, np.inf).min(axis=axis, initial=np.inf))
        self.known[at] += known.sum(axis=axis)
        self.exceeding[at] += (np.where(known, r, -2.0) > self.above).sum(axis=axis)

    def frame(self, store: str, ids: np.ndarray) -> pd.DataFrame:
        low, high = (np.where(np.isfinite(v), v, np.nan) for v in (self.min, self.max))
        return pd.DataFrame({store: ids, "sum_r": self.sum, "max_r": high, "min_r": low, "n_r": self.known, "n_above": self.exceeding, "n_self": self.own})


def _per_store(df, store, week, value, by, fill_zero, above, lag, block) -> DataFrame:
    """Per store: sum, count, extremes of its correlations and how many exceed ``above``.

    With ``lag`` the store's week t meets the other store's week t + lag (by position); ``n_self``,
    whether the store correlates with itself, is told without a lag only.
    """
    kind = df.schema[store].dataType
    stats = ["sum_r", "max_r", "min_r"]
    out = T.StructType(
        [df.schema[k] for k in by]
        + [T.StructField(store, kind)]
        + [T.StructField(c, T.DoubleType()) for c in stats]
        + [T.StructField(c, T.LongType()) for c in ("n_r", "n_above", "n_self")]
    )

    def ends(x: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Rows as the leading and as the following side."""
        if not lag:
            both = _prepared(x, fill_zero)
            return both, both
        return _prepared(x[:, :-lag], fill_zero), _prepared(x[:, lag:], fill_zero)

    def kernel(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, same = _both_sides(key, batches, store)
        if left is None or right is None:
            return
        leads, follows = ends(left[1])
        of_left = _Reduced(len(left[0]), above)
        parts = [(left[0], of_left)]
        if same:
            for rows, r in _tiles(leads, follows):
                own = np.arange(len(rows)), rows
                of_left.own[rows] = 0 if lag else ~np.isnan(r[own])
                r[own] = np.nan
                of_left.add(rows, r, 1)
        else:
            of_right = _Reduced(len(right[0]), above)
            parts.append((right[0], of_right))
            other_leads, other_follows = ends(right[1])
            for rows, r in _tiles(leads, other_follows):
                of_left.add(rows, r, 1)
                if not lag:
                    of_right.add(slice(None), r, 0)
            for rows, r in _tiles(other_leads, follows) if lag else ():
                of_right.add(rows, r, 1)
        for ids, reduced in parts:
            found = reduced.frame(store, ids)
            for k, v in zip(reversed(by), reversed(key[:-2])):
                found.insert(0, k, v)
            yield found

    cells = _block_pairs(df, store, week, value, by, block)
    partial = cells.groupBy(*by, "_lo", "_hi").applyInPandas(kernel, out)
    return partial.groupBy(*by, store).agg(
        F.sum("sum_r").alias("sum_r"),
        F.max("max_r").alias("max_r"),
        F.min("min_r").alias("min_r"),
        F.sum("n_r").alias("n_r"),
        F.sum("n_above").alias("n_above"),
        F.sum("n_self").alias("n_self"),
    )


def store_correlations(
    df: DataFrame, store: str, week: str, value: str, fill_zero: bool = True, by: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Every store pair once with its correlation of weekly means.

    A missing week counts as 0 with ``fill_zero``, otherwise only shared weeks count. The result
    has stores squared / 2 rows by definition.
    """
    return _pairs(df, store, week, value, by, fill_zero, None, block)


def similar_pairs(
    df: DataFrame, store: str, week: str, value: str, threshold: float = 0.7, fill_zero: bool = True, block: int = BLOCK
) -> DataFrame:
    """Store pairs above ``threshold``; the others never leave the task.

    With ``fill_zero``, blocks of stores that cannot reach it are not compared at all.
    """
    if fill_zero:
        return correlated_pairs(df, store, week, value, threshold, block)
    return _pairs(df, store, week, value, (), fill_zero, threshold, block)


def first_similar_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.orderBy("store_a", "store_b").limit(k)


def network_stats(
    df: DataFrame, store: str, week: str, value: str, fill_zero: bool = True, min_stores: int = 3, block: int = BLOCK
) -> DataFrame:
    """Mean, maximum and minimum correlation over all pairs; undefined pairs are left out."""
    per = _per_store(df, store, week, value, (), fill_zero, 2.0, 0, block)
    out = per.agg(
        F.count(F.lit(1)).alias("stores"),
        F.try_divide(F.sum("sum_r"), F.sum("n_r")).alias("mean_r"),
        F.max("max_r").alias("max_r"),
        F.min("min_r").alias("min_r"),
    )
    return out.where(F.col("stores") >= min_stores)


def _mean_with_all(df: DataFrame, store: str, week: str, value: str) -> DataFrame:
    cells = numbers_by(df, [store, week], {"_value": F.avg(value)}).where(F.col("_value").isNotNull())
    weeks = cells.agg(F.count_distinct(week).alias("n")).scalar()
    mean = F.sum("_value") / weeks
    square = F.sum(F.col("_value") * F.col("_value")) - F.sum("_value") * mean
    scale = F.sqrt(F.greatest(square, F.lit(0.0)))
    flat = scale <= F.lit(1e-7) * F.greatest(F.max(F.abs("_value")), F.lit(1e-300)) * F.sqrt(weeks.cast("double"))
    per = cells.groupBy(store).agg(mean.alias("_mean"), F.when(~flat, scale).alias("_scale"))
    cells = cells.join(per, store)
    by_week = cells.groupBy(week).agg(F.sum(F.col("_value") / F.col("_scale")).alias("_sum"))
    rest = scalar_row(by_week.agg(F.sum("_sum").alias("total")))["total"]
    stores = per.agg(F.count("_scale").alias("n")).scalar()
    met = cells.join(by_week, week).groupBy(store).agg(
        F.sum(F.col("_value") * F.col("_sum")).alias("_dot"), F.first("_mean").alias("_mean"), F.first("_scale").alias("_scale")
    )
    return met.select(store, ((F.col("_dot") - F.col("_mean") * rest) / F.col("_scale") / stores).alias("mean_r"))


def connectedness(
    df: DataFrame, store: str, week: str, value: str, fill_zero: bool = True, block: int = BLOCK
) -> DataFrame:
    """Mean correlation of each store with all stores, itself (1.0) included.

    With zero fill the rows z of standardised weeks give r_ij = z_i z_j, and the sum over all j is
    z_i times the sum of the z_j: two aggregations over (store, week), no pairs.
    """
    if fill_zero:
        return _mean_with_all(df, store, week, value)
    per = _per_store(df, store, week, value, (), fill_zero, 2.0, 0, block)
    mean = F.try_divide(F.col("sum_r") + F.col("n_self"), F.col("n_r") + F.col("n_self"))
    return per.select(store, mean.alias("mean_r"))


def connectedness_extremes(connected: DataFrame, store: str) -> DataFrame:
    return both_ends(connected, "mean_r", store, 1)


def influence_scores(
    df: DataFrame, store: str, week: str, value: str, threshold: float = 0.3, lag: int = 1, block: int = BLOCK
) -> DataFrame:
    """Number of other stores whose values ``lag`` weeks later follow each store's values."""
    per = _per_store(df, store, week, value, (), True, threshold, lag, block)
    return per.select(store, F.col("n_above").alias("influences"))


def price_coordination(
    df: DataFrame, province: str, store: str, week: str, value: str, block: int = BLOCK
) -> DataFrame:
    """Mean pair correlation among the stores of each province with more than one store."""
    per = _per_store(df, store, week, value, (province,), False, 2.0, 0, block)
    out = per.groupBy(province).agg(
        F.count(F.lit(1)).alias("stores"), F.try_divide(F.sum("sum_r"), F.sum("n_r")).alias("mean_r")
    )
    return out.where(F.col("stores") > 1)
