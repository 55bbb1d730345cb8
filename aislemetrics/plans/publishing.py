"""Weekly refresh of the price-gap dashboard without a rebuild.

Every step up to the display view works week by week, so what a week contributes is kept in tables
partitioned by week: rolled-up sales with market measures, counts of own and competitor price pairs,
group sales, and the merged rows. Publishing a week reads that week of each fact, overwrites its
partitions and merges anew the weeks whose standing changed: the week itself, and those that leave
the price history because of it. Figures that depend on the weeks present (the 52-week history, the
span of sales) are taken from the kept tables. Publishing a week again replaces it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import WEEK_SHIFT
from ..session import kept_table, materialize, path_exists, remove_path, scratch_path
from . import price_gap as pg

OWN, COMPETITOR = ["own_reg", "own_live"], ["comp_reg", "comp_live"]
GROUP_SALES = ("units", "sales", "promo_units", "promo_sales", "baseline_units", "incremental_units")
FEW = 32  # weeks that are read by their folders
_WEEKS = "week int, sold boolean, note int"


def _named(counts: DataFrame, kind: str, pair: Sequence[str]) -> DataFrame:
    """Pair counts of both kinds in one shape, so that they are one table."""
    return counts.select("week", "region", "group_code", F.lit(kind).alias("kind"), *[F.col(c).cast("double").alias(n) for c, n in zip(pair, ("a", "b"))], "n")


def _unnamed(counts: DataFrame, kind: str, pair: Sequence[str]) -> DataFrame:
    return counts.where(F.col("kind") == kind).select("week", "region", "group_code", *[F.col(n).alias(c) for c, n in zip(pair, ("a", "b"))], "n")


@dataclass(frozen=True)
class WeeklyTables:
    """The kept tables of one dashboard under ``root``, a folder that all executors share."""

    root: str
    as_of: dt.date
    after_week: int
    history: int = 52
    span: int = 200
    strict_week: bool = False
    fix_comp_live: bool = False

    def _read(self, spark: SparkSession, name: str, weeks: Sequence[int] | None = None) -> DataFrame | None:
        """A kept table, or some weeks of it; None if it holds none of them.

        A few weeks are read by their folders, so that the other partitions are not even listed.
        """
        base = f"{self.root}/{name}"
        paths = [base]
        if weeks is not None and len(weeks) <= FEW:
            paths = [p for p in (f"{base}/week={w}" for w in weeks) if path_exists(spark, p)]
        elif not path_exists(spark, base):
            paths = []
        return spark.read.option("basePath", base).parquet(*paths) if paths else None

    def _replace(self, df: DataFrame, name: str, weeks: Iterable[int]) -> None:
        """Overwrite the partitions of ``weeks`` and no others; a week without rows loses its partition."""
        spark = df.sparkSession
        # folded rows, counted by week and then written; as Parquet, since a load of all weeks is large
        path, schema = scratch_path(spark, "staged"), df.schema
        df.write.parquet(path)
        df = spark.read.schema(schema).parquet(path)
        present = {r.week for r in df.select("week").distinct().collect()}
        for week in set(weeks) - present:
            remove_path(spark, f"{self.root}/{name}/week={week}")
        if present:
            writer = df.repartition("week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("week").parquet(f"{self.root}/{name}")
        remove_path(spark, path)

    def _weeks(self, spark: SparkSession) -> list[int]:
        """Published weeks with sales, newest first; a few hundred at most. The last note on a week counts."""
        if not path_exists(spark, f"{self.root}/weeks"):
            return []
        notes = spark.read.schema(_WEEKS).parquet(f"{self.root}/weeks").groupBy("week").agg(F.max_by("sold", "note").alias("sold"))
        return sorted((r.week for r in notes.where("sold").collect()), reverse=True)

    def _note(self, spark: SparkSession, weeks: Sequence[int], sold: set[int]) -> None:
        notes = 0
        if path_exists(spark, f"{self.root}/weeks"):
            notes = spark.read.schema(_WEEKS).parquet(f"{self.root}/weeks").agg(F.max("note")).first()[0] or 0
        rows = spark.createDataFrame([(w, w in sold, notes + 1) for w in weeks], _WEEKS)
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/weeks")

    def _priced_after(self, weeks: Sequence[int]) -> int | None:
        """The week after which prices count, as in the full plan: none without a full history."""
        return weeks[self.history - 1] if len(weeks) >= self.history else None

    def publish(self, inputs: pg.PriceGapInputs, weeks: Sequence[int]) -> list[int]:
        """Take in ``weeks`` of every fact; returns the weeks whose merged rows were made anew."""
        spark = inputs.sales.sparkSession
        wanted = sorted({w for w in weeks if w > self.after_week})
        before = self._weeks(spark)
        codes = [w - WEEK_SHIFT for w in wanted]
        one = replace(
            inputs,
            sales=inputs.sales.where(F.col("wm_yr_wk_nbr").isin(wanted)),
            prices=inputs.prices.where(F.col("wm_wk_nbr").isin(codes)),
            competitor=inputs.competitor.where(F.col("hg_week").isin(codes)),
            market=inputs.market.where(F.col("promo_yr_wk").isin(codes)),
            group_metrics=inputs.group_metrics.where(F.col("promo_hg_yr_wk").isin(codes)),
        )
        groups = pg.group_map(inputs.catalog)
        # no bound of their own: all weeks of the call
        calendar = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(wanted, reverse=True))], "week int, seq int")
        everything = F.lit(0).cast("int")
        items = pg.item_sales(one.sales, one.catalog, one.stores, calendar, span=10**6)
        volume = kept_table(pg.item_volume_levels(pg.item_volume(items)))
        read = pg.market_rows_read(one.market)
        parts = pg.market_parts(read)
        clean = pg.market_clean(pg.market_of_own_items(read, one.upc_map, volume), for_map=True, measures=pg.READ_MEASURES, parts=parts)
        # kept as in the plan: the filters of the join reach one of its two levels only, and the feed would be sent once for each
        market = kept_table(pg.market_pivot(clean, one.upc_map, parts))
        rolled = pg.roll_up_upcs(pg.attach_market(volume, market))
        own = pg.pair_counts(pg.own_prices(one.prices, groups, everything), OWN)
        low = pg.market_low(pg.competitor_prices(one.competitor, groups, everything, distinct=False))
        counts = _named(own, "own", OWN).unionByName(_named(pg.pair_counts(low, COMPETITOR), "competitor", COMPETITOR))
        sales = pg.group_sales(one.group_metrics, calendar, 1, max(1, len(wanted)))
        for name, df in (("rolled", rolled), ("price_counts", counts), ("group_sales", sales)):
            self._replace(df, name, wanted)
        self._note(spark, wanted, {r[0] for r in one.sales.select("wm_yr_wk_nbr").distinct().collect()})
        after = self._weeks(spark)
        changed = sorted(set(wanted) | self._moved(before, after))
        merged = self._merge(spark, after, changed)
        if merged is not None:
            self._replace(merged, "merged", changed)
        for week in changed if merged is None else ():
            remove_path(spark, f"{self.root}/merged/week={week}")
        return changed

    def _moved(self, before: list[int], after: list[int]) -> set[int]:
        """Weeks published earlier that count prices or group sales in one state and not in the other."""

        def standing(weeks: list[int]) -> dict[int, tuple[bool, bool]]:
            bound = self._priced_after(weeks)
            return {w: (bound is not None and w > bound, bound is not None and bound <= w <= weeks[0]) for w in weeks}

        old, new = standing(before), standing(after)
        return {w for w in old if old[w] != new.get(w)}

    def _merge(self, spark: SparkSession, weeks: list[int], changed: Sequence[int]) -> DataFrame | None:
        """Merged rows of ``changed`` from the kept tables; group-level rows, no fact is read."""
        bound = self._priced_after(weeks)
        of = F.col("week").isin(list(changed))
        priced = of & (F.col("week") > bound) if bound is not None else F.lit(False)
        sold = of & F.col("week").between(bound, weeks[0]) if bound is not None else F.lit(False)

        rolled = self._read(spark, "rolled", changed)
        if rolled is None:
            return None
        counts = self._read(spark, "price_counts", changed)
        blank = F.lit(None).cast("double")
        counts = counts if counts is not None else _named(rolled.limit(0).withColumns({c: blank for c in ("n", *OWN)}), "own", OWN)
        own, low = (_unnamed(counts.where(priced), kind, pair) for kind, pair in (("own", OWN), ("competitor", COMPETITOR)))
        out = pg.attach_prices(rolled.where(of), pg.modal_pairs(own, OWN), pg.modal_pairs(low, COMPETITOR))
        out = pg.dollar_weighted(pg.repair_competitor(pg.infer_competitor(out)), self.fix_comp_live)
        sales = self._read(spark, "group_sales", changed)
        sales = sales if sales is not None else rolled.limit(0).select("week", "region", "group_code", *[blank.alias(c) for c in GROUP_SALES])
        return pg.attach_group_sales(out, sales.where(sold))

    def merged(self, spark: SparkSession) -> DataFrame:
        """The merged rows of all weeks in the span of sales."""
        weeks = self._weeks(spark)
        found = self._read(spark, "merged")
        if found is None or not weeks:
            raise ValueError(f"nothing published under {self.root}")
        return found.where(F.col("week") >= weeks[0] - self.span)

    def shown(self, inputs: pg.PriceGapInputs, first: str, last: str) -> DataFrame:
        """The display range over the kept rows; calendar and actioned list are read as they are now."""
        calendar = materialize(pg.display_calendar(inputs.calendar, self.as_of))
        merged = self.merged(inputs.sales.sparkSession)
        return pg.display_range(pg.actioned_view(merged, inputs.actioned, calendar, self.as_of, self.strict_week), first, last)
