"""Mergeable states of distinct counts and quantiles.

A state per fine key is stored once; any coarser level is a merge of states, so that it reads one row
per fine key instead of the fact, and a new week adds its own states and touches no other. Distinct
counts are HyperLogLog states, quantiles KLL states; both have a fixed size whatever the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import col, has_keys

LG_K = 12  # log2 of the registers of a distinct-count state
KLL_K = 200  # width of a quantile state
#: Three standard deviations of the estimate, relative to the exact count.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
#: Distance of the estimate's rank from the wanted one, as a share of the rows; stated for 99 %, here doubled.
RANK_ERROR = 2 * 0.0133
HOT_PARTS = 1000  # a dimension with one row in so many is looked up by broadcast: at most as many a level
TASK_ROWS = 1 << 20  # rows whose distinct keys one task counts


def states(
    df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str | Column], values: Mapping[str, str | Column]
) -> DataFrame:
    """One row per key: ``n`` rows, a ``<name>_hll`` for each distinct count, a ``<name>_kll`` for each measure.

    Rows without a key are left out, NULL values are not counted.
    """
    return (
        has_keys(df, *keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.hll_sketch_agg(col(c), LG_K).alias(f"{n}_hll") for n, c in distinct.items()],
            *[F.kll_sketch_agg_double(col(c).cast("double"), F.lit(KLL_K)).alias(f"{n}_kll") for n, c in values.items()],
        )
    )


def rolled_up(stored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The states of coarser ``keys`` (none: of everything), by merging; fine keys may be renamed or derived first."""
    hll = [c for c in stored.columns if c.endswith("_hll")]
    kll = [c for c in stored.columns if c.endswith("_kll")]
    return stored.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.hll_union_agg(c).alias(c) for c in hll], *[F.kll_merge_agg_double(c).alias(c) for c in kll]
    )


def estimates(rolled: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """States read out: ``<name>_distinct`` and, for each entry of ``probs``, ``<name>_<entry>``."""
    out = [c for c in rolled.columns if not c.endswith(("_hll", "_kll"))]
    for c in rolled.columns:
        if c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(c).alias(f"{c[:-4]}_distinct"))
        if c.endswith("_kll"):
            out += [F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(p))).alias(f"{c[:-4]}_{n}") for n, p in probs.items()]
    return rolled.select(*out)


def levels(stored: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """States of several levels in one frame (level, dimension); a level is one expression of the fine keys."""
    rows = [F.struct(F.lit(n).alias("level"), c.cast("string").alias("dimension")) for n, c in dimensions.items()]
    return rolled_up(stored.select("*", F.inline(F.array(*rows))), ["level", "dimension"])


def checked(
    df: DataFrame, stored: DataFrame, dimensions: Mapping[str, Column], key: str, value: str, prob: float = 0.5
) -> DataFrame:
    """Estimates of the stored states beside the exact figures of ``df``, at every level.

    level, dimension, rows, exact (distinct ``key``), estimate, within (of ``DISTINCT_ERROR``), middle
    (the sketched quantile of ``value``), middle_within: its exact rank lies within ``RANK_ERROR``.
    """
    spark = df.sparkSession
    rows = [F.struct(F.lit(n).alias("level"), c.cast("string").alias("dimension")) for n, c in dimensions.items()]
    on = ["level", "dimension"]
    # one row per dimension, read by both kinds of look-up
    sketched = materialize(
        estimates(levels(stored, dimensions), {"middle": prob}).select(
            *on, F.col("n").alias("rows"), F.col(f"{key}_distinct").alias("estimate"), F.col(f"{value}_middle").alias("middle")
        )
    )
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tall = df.select(key, value, F.inline(F.array(*rows)))
    # distinct keys are counted by (level, dimension, key) first, so that a hot level is spread over its keys
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * len(dimensions) // TASK_ROWS)
    spread = tall.where(F.col(key).isNotNull()).select(*on, key).repartition(parts, *on, key)
    exact = spread.groupBy(*on, key).agg(F.lit(1).alias("one")).groupBy(*on).agg(F.sum("one").alias("exact"))
    # the rows of a hot dimension stay where they are read
    hot = F.col("rows") * HOT_PARTS >= total
    few, many = (sketched.where(which).select(*on, "middle") for which in (hot, ~hot))
    measured = tall.select(*on, value)
    cold = measured.join(F.broadcast(few.select(*on)), on, "left_anti").repartition(parts, *on)

    def below(placed: DataFrame) -> DataFrame:
        return placed.groupBy(*on).agg(
            F.avg((F.col(value) < F.col("middle")).cast("int")).alias("below"), F.avg((F.col(value) <= F.col("middle")).cast("int")).alias("upto")
        )

    ranks = below(measured.join(F.broadcast(few), on)).unionByName(below(cold.join(many, on)))
    near = (F.col("below") <= prob + RANK_ERROR) & (F.col("upto") >= prob - RANK_ERROR)
    return (
        sketched.join(exact, on)
        .join(ranks, on)
        .select(
            *on, "rows", "exact", "estimate", (F.abs(F.col("estimate") - F.col("exact")) <= F.ceil(F.col("exact") * DISTINCT_ERROR)).alias("within"),
            "middle", near.alias("middle_within"),
        )
    )
