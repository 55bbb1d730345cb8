"""Prefilter of the market feed and stored sketch states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemetrics.functions import prefilter, sketches
from aislemetrics.plans import price_gap as pg
from aislemetrics.sources.retail_views import RetailViews

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("broadcast", [prefilter.BROADCAST_BYTES, 0])
def test_prefilter_keeps_every_known_key(spark, monkeypatch, broadcast):
    monkeypatch.setattr(prefilter, "BROADCAST_BYTES", broadcast)
    keys = spark.range(0, 9000, 3).select(F.concat(F.lit("k"), "id")).union(spark.createDataFrame([(None,)], "k string"))
    df = spark.range(9000).select(F.concat(F.lit("k"), "id").alias("name"), "id").union(spark.createDataFrame([(None, -1)], "name string, id long"))
    got = {r.id for r in prefilter.with_known_keys(df, F.col("name"), keys).collect()}
    assert set(range(0, 9000, 3)) <= got and len(got) < 3000 + 6000 * 0.05 and -1 not in got
    assert prefilter.with_known_keys(df, F.col("name"), keys.limit(0)).count() == 0


def test_the_filter_is_in_the_plan_once(spark, monkeypatch):
    monkeypatch.setattr(prefilter, "BROADCAST_BYTES", 0)
    ids = spark.range(100).select(F.col("id").cast("string").alias("name"))
    plan = prefilter.with_known_keys(ids, F.col("name"), ids)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery#") == 1


@pytest.mark.parametrize("broadcast", [prefilter.BROADCAST_BYTES, 0])
def test_market_rows_of_other_items_go_before_the_exchange(spark, monkeypatch, broadcast):
    """Only every fifth item is sold: four fifths of the feed go, and what is attached stays the same."""
    monkeypatch.setattr(prefilter, "BROADCAST_BYTES", broadcast)
    v = RetailViews(spark, FOLDER)
    sales = v.weekly_sales.where("item_nbr % 5 = 0")
    weeks = pg.sales_weeks(sales, 199452)
    volume = pg.item_volume_levels(pg.item_volume(pg.item_sales(sales, v.catalog, v.store_dim, weeks)))
    feed = pg.market_rows_read(v.market_source)
    kept = pg.market_of_own_items(feed, v.upc_map, volume)
    assert kept.count() < feed.count() / 3
    one, two = (pg.attach_market(volume, pg.market_pivot(pg.market_clean(f), v.upc_map)) for f in (feed, kept))
    rounded = [F.round(c, 6).alias(c) if c in pg.MARKET_READ else c for c in one.columns]
    assert one.select(*rounded).exceptAll(two.select(*rounded)).isEmpty() and two.count() == one.count()


def test_feed_is_shuffled_once(spark):
    v = RetailViews(spark, FOLDER)
    plan = pg.market_clean(v.market_source).groupBy("promo_yr_wk", "region", "market_upc").agg(F.sum("sales").alias("x"))
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    tall = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "market_upc" in line]
    assert len(tall) == 1


def test_states_merge_like_one_pass(spark):
    rng = np.random.default_rng(2)
    rows = [(int(w), int(s), int(i), float(x)) for w, s, i, x in zip(rng.integers(0, 6, 20000), rng.integers(0, 4, 20000), rng.integers(0, 3000, 20000), rng.gamma(1, 50, 20000))]
    df = spark.createDataFrame(rows, "week int, store int, item int, amount double")
    fine = sketches.states(df, ["week", "store"], {"item": "item"}, {"amount": "amount"})
    assert fine.count() == 24
    whole = sketches.estimates(sketches.rolled_up(fine), {"p50": 0.5, "p90": 0.9}).first()
    assert whole.n == 20000 and abs(whole.item_distinct - len({r[2] for r in rows})) <= 3000 * sketches.DISTINCT_ERROR
    amounts = np.sort([r[3] for r in rows])
    for got, p in ((whole.amount_p50, 0.5), (whole.amount_p90, 0.9)):
        assert abs(np.searchsorted(amounts, got) / 20000 - p) <= sketches.RANK_ERROR
    # a week that comes later adds its states and changes no other
    later = sketches.states(df.where("week = 5"), ["week", "store"], {"item": "item"}, {"amount": "amount"})
    grown = sketches.states(df.where("week < 5"), ["week", "store"], {"item": "item"}, {"amount": "amount"}).unionByName(later)
    a, b = ({r.store: r.item_distinct for r in sketches.estimates(sketches.rolled_up(f, ["store"]), {}).collect()} for f in (fine, grown))
    assert a == b


def test_states_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, 5, 2.0), (None, 6, 3.0), (2, None, None)], "week int, item int, amount double")
    got = {r.week: r for r in sketches.estimates(sketches.states(df, ["week"], {"item": "item"}, {"amount": "amount"}), {}).collect()}
    assert {w: (r.n, r.item_distinct) for w, r in got.items()} == {1: (2, 1), 2: (1, 0)}
