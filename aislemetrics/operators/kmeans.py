"""k-means that gives the same clusters whatever the partitioning.

Features are standardised and held as whole numbers, so sums do not depend on the order of addition.
The first centre is the point with the smallest id, each further one the point that is farthest from
all chosen ones (the smallest id on a tie). A Lloyd step is one aggregation: points are assigned in the
tasks that hold them, and only sums per cluster are shuffled. The driver holds k centres.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import materialize

SCALE = 10_000  # whole numbers hold standardised values to four digits
OFFSET = 1_000 * SCALE  # added, so that divisions meet no negative number
ROUNDS = 25


def standardised(features: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """id and ``_at``: whole standardised values. A constant column is 0 everywhere."""
    moments = features.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).first()
    values = []
    for c in columns:
        m, s = moments[c]
        value = ratio(F.col(c) - F.lit(m), F.lit(s), default=0.0) if s else F.lit(0.0)
        values.append((F.round(value * SCALE) + OFFSET).cast("long"))
    return features.select(id_col, F.array(*values).alias("_at"))


def _distance(at: Column, center: Sequence[int]) -> Column:
    parts = [(F.get(at, i) - F.lit(int(c)).cast("long")) * (F.get(at, i) - F.lit(int(c)).cast("long")) for i, c in enumerate(center)]
    return sum(parts[1:], parts[0])


def _nearest(at: Column, centers: Sequence[tuple[int, Sequence[int]]]) -> Column:
    """The cluster whose centre is nearest; the first of equally near ones."""
    return F.array_min(F.array(*[F.struct(_distance(at, c).alias("d"), F.lit(i).alias("i")) for i, c in centers]))["i"]


def farthest_first(points: DataFrame, id_col: str, k: int) -> list[Sequence[int]]:
    """k starting centres; fewer if there are fewer different points."""
    chosen = [points.orderBy(id_col).select("_at").first()["_at"]]
    while len(chosen) < k:
        least = F.least(*[_distance(F.col("_at"), c) for c in chosen], *([F.lit(None).cast("long")] if len(chosen) == 1 else []))
        far = points.agg(F.min(F.struct((-least).alias("d"), F.col(id_col).alias("id"), "_at")).alias("best")).first()["best"]
        if far["d"] == 0:
            break
        chosen.append(far["_at"])
    return chosen


def fit(points: DataFrame, id_col: str, k: int, rounds: int = ROUNDS) -> list[tuple[int, Sequence[int]]]:
    """Numbered centres after at most ``rounds`` Lloyd steps. A cluster that loses all points is gone."""
    centers = list(enumerate(farthest_first(points, id_col, k)))
    dims = len(centers[0][1])
    for _ in range(rounds):
        sums = points.groupBy(_nearest(F.col("_at"), centers).alias("i")).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.get("_at", F.lit(d))).alias(f"s{d}") for d in range(dims)]
        )
        moved = sorted((r["i"], [(2 * r[f"s{d}"] + r["n"]) // (2 * r["n"]) for d in range(dims)]) for r in sums.collect())
        if moved == [(i, list(c)) for i, c in centers]:
            break
        centers = moved
    return centers


def clustered(features: DataFrame, id_col: str, columns: Sequence[str], k: int, rounds: int = ROUNDS) -> DataFrame:
    """``features`` with a ``cluster`` number from 0, in the order of the starting centres."""
    points = materialize(standardised(features, id_col, columns))  # read again in every step
    centers = fit(points, id_col, k, rounds)
    labels = points.select(F.col(id_col).alias("_id"), _nearest(F.col("_at"), centers).cast("int").alias("cluster"))
    return features.join(labels, F.col(id_col) == F.col("_id")).drop("_id")
