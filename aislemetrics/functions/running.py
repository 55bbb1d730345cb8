"""Running totals, and exact quantiles by distributed selection; neither sorts a whole table in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scalar_row
from .columns import col, has_keys

_PART = "_range_part"
ACCURACY = 10_000  # of the sketch that brackets a quantile
SMALL = 20_000  # rows of a group that are all candidates
BROADCAST_BYTES = 32 << 20


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    measures: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``<name>_running`` and ``<name>_total`` for each measure, in ``order`` within ``by``.

    A window without partition keys moves all rows into one task. Here rows are
    range-partitioned on ``(by, order)`` (tied values spread over the ranges by the later order
    columns), each range is summed in parallel, and the totals of the earlier ranges (one row
    per range and key) are added. ``order`` must be a total order, so end it with a unique key.
    """
    order = [col(c) for c in order]
    staged = df.withColumns({f"_m_{n}": c for n, c in measures.items()})
    ranged = materialize(
        staged.repartitionByRange(*[F.col(k) for k in by], *order).withColumn(_PART, F.spark_partition_id())
    )
    parts = ranged.groupBy(*by, _PART).agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in measures])
    across = Window.partitionBy(*by)
    earlier = across.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *by,
        _PART,
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_o_{n}") for n in measures],
        *[F.sum(f"_s_{n}").over(across).alias(f"{n}_total") for n in measures],
    )
    if not by:
        # one row per range partition, at most spark.sql.shuffle.partitions rows
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*by, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_r_{n}": F.sum(f"_m_{n}").over(inside) for n in measures})
    joined = local.join(offsets, [*by, _PART])
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.col(f"_r_{n}")).alias(f"{n}_running") for n in measures],
        *[F.col(f"{n}_total") for n in measures],
    )


def _brackets(data: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Per group: its size and, for each probability, two values that hold the wanted ranks between them.

    The values come from a quantile sketch of relative error ``1 / ACCURACY``; four times that on
    either side leaves slack. Small groups get their ends, so that all their values are candidates.
    """
    margin = 4 / ACCURACY
    spots = [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = F.percentile_approx("_v", [float(x) for x in spots], ACCURACY)
    known = data.groupBy(*by).agg(F.count("_v").alias("_size"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_at"))
    few = F.col("_size") <= SMALL
    ends = []
    for i, p in enumerate(probs):
        ends.append(F.when(few | F.lit(p - margin <= 0), F.col("_min")).otherwise(F.col("_at")[2 * i]).alias(f"_lo{i}"))
        ends.append(F.when(few | F.lit(p + margin >= 1), F.col("_max")).otherwise(F.col("_at")[2 * i + 1]).alias(f"_hi{i}"))
    return known.select(*by, "_size", *ends)


def _candidates(data: DataFrame, probs: Sequence[float], by: Sequence[str], groups: int | None) -> DataFrame:
    """Counts of the values inside the brackets, and of all rows between two brackets as one."""
    ends = _brackets(data, probs, by)
    names = ["_size", *[f"_{side}{i}" for i in range(len(probs)) for side in ("lo", "hi")]]
    if not by:
        row = scalar_row(ends)
        placed = data.withColumns({n: row[n] for n in names})
    else:
        if groups is None:
            ends = materialize(ends)  # a row per group; read again below
            groups = ends.count()
        placed = data.join(F.broadcast(ends) if groups * 24 * (len(names) + len(by)) <= BROADCAST_BYTES else ends, list(by))
    inside, passed = F.lit(False), F.lit(0)
    for i in range(len(probs)):
        inside |= (F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}"))
        passed += (F.col("_v") > F.col(f"_hi{i}")).cast("int")
    placed = placed.select(*by, "_size", "_v", F.when(inside, F.col("_v")).alias("_c"), F.when(~inside, passed).alias("_gap"))
    return placed.groupBy(*by, "_c", "_gap").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_first"), F.min("_size").alias("_size"))


def quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    by: Sequence[str] = (),
    groups: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group (one row without ``by``).

    Selection instead of sorting: a sketch gives two values around each wanted rank, one counting
    pass counts the rows between these brackets as a whole and the few inside them by value, and only
    the latter are put in order (``8 / ACCURACY`` of a group for each probability; groups of up to
    ``SMALL`` rows whole). Both passes combine in the map tasks, so a hot group is no hot task. A rank
    outside its bracket would be an error of the sketch and raises. ``groups``: a bound of the number
    of groups, if known; else they are counted, to broadcast the brackets only if they are small.
    """
    names = list(names or [f"q{round(p * 100):02d}" for p in probs])
    data = has_keys(df, *by).select(*by, col(value).alias("_v")).where(F.col("_v").isNotNull())
    ordered = Window.partitionBy(*by).orderBy("_first").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _candidates(data, probs, by, groups).withColumn("_upto", F.sum("_n").over(ordered))
    before = F.col("_upto") - F.col("_n")
    picks, results = [], []
    for p, name in zip(probs, names):
        place = F.lit(float(p)) * (F.col("_size") - 1)
        for side, spot in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((before <= spot) & (spot < F.col("_upto")), F.col("_c"))).alias(f"_{side}_{name}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_f_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        lost = F.col(f"_f_{name}").isNotNull() & (lo.isNull() | hi.isNull())
        exact = lo + (hi - lo) * F.col(f"_f_{name}")
        results.append(F.when(lost, F.raise_error(F.lit(f"rank of {name} outside its bracket")).cast("double")).otherwise(exact).alias(name))
    picked = ranked.groupBy(*by).agg(*picks) if by else ranked.agg(*picks)
    return picked.select(*by, *results)


def quantile_row(df: DataFrame, value: str | Column, probs: Sequence[float], names: Sequence[str] | None = None) -> Column:
    """:func:`quantiles` without groups, as a struct-valued scalar subquery."""
    return scalar_row(quantiles(df, value, probs, names))


def quantiles_row(df: DataFrame, columns: Sequence[str], prob: float = 0.5) -> Column:
    """One quantile of several columns, as a struct-valued scalar subquery with a field for each.

    The columns share one counting pass. ``df`` should be a few kept rows; it is read once.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "_column", "_value")
    each = quantiles(long, "_value", [prob], ["_q"], by=["_column"], groups=len(columns))
    return scalar_row(each.agg(*[F.max(F.when(F.col("_column") == c, F.col("_q"))).alias(c) for c in columns]))


def cumulative_share(df: DataFrame, entity: str | Sequence[str], measure: str) -> DataFrame:
    """Entities in descending order of ``measure``: rank, running sum and running share in %."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    run = running_totals(
        df.select(*keys, measure),
        [F.desc(measure), *keys],
        {"_x": F.coalesce(F.col(measure), F.lit(0.0)), "_k": F.lit(1)},
    )
    return run.select(
        *keys,
        measure,
        F.col("_k_running").cast("long").alias("position"),
        F.col("_k_total").cast("long").alias("entities"),
        F.col("_x_running").alias("cum_value"),
        F.col("_x_total").alias("total_value"),
        (F.try_divide(F.col("_x_running"), F.col("_x_total")) * 100).alias("cum_pct"),
    )
