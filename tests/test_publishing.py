"""Weekly publishing against a full rebuild."""

import dataclasses

import pytest
from pyspark.sql import functions as F

import workload.price_gap as W
from aislemetrics.plans import price_gap as pg
from aislemetrics.plans.publishing import WeeklyTables
from aislemetrics.sources.retail_views import RetailViews

FACTS = {"sales": ("wm_yr_wk_nbr", 0), "prices": ("wm_wk_nbr", 190000), "competitor": ("hg_week", 190000), "market": ("promo_yr_wk", 190000), "group_metrics": ("promo_hg_yr_wk", 190000)}


def of_weeks(inputs, weeks):
    """Inputs whose facts hold nothing but ``weeks``."""
    codes = {n: F.col(c).isin([w - shift for w in weeks]) for n, (c, shift) in FACTS.items()}
    return dataclasses.replace(inputs, **{n: getattr(inputs, n).where(c) for n, c in codes.items()})


def rows(df):
    doubles = [c for c, t in df.dtypes if t == "double"]
    out = df.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in doubles}).select(*sorted(df.columns))
    return sorted(map(str, out.collect()))


@pytest.fixture(scope="module")
def inputs(spark):
    v = RetailViews(spark, "/root/testdata/sf0.001")
    own = W.inputs(v)
    weeks = sorted(r.week for r in pg.sales_weeks(own.sales, W.AFTER_WEEK).select("week").collect())[-57:]
    data = of_weeks(own, weeks)
    # as tables, as facts are in production
    return weeks, dataclasses.replace(data, **{n: getattr(data, n).checkpoint() for n in FACTS})


def test_a_week_reads_itself_and_equals_the_rebuild(spark, inputs, tmp_path):
    weeks, data = inputs
    tables = WeeklyTables(f"{tmp_path}/weekly", W.AS_OF, W.AFTER_WEEK)
    plan = lambda upto: pg.PriceGapPlan(of_weeks(data, weeks[:upto]), W.AS_OF, W.AFTER_WEEK, *W.SHOWN).merged
    tables.publish(data, weeks[:55])
    assert rows(tables.merged(spark)) == rows(plan(55))
    # facts that hold one week only: what came before is read from the kept tables
    assert tables.publish(of_weeks(data, weeks[55:56]), weeks[55:56]) == [weeks[3], weeks[4], weeks[55]]
    assert rows(tables.merged(spark)) == rows(plan(56))
    tables.publish(of_weeks(data, weeks[56:]), weeks[56:])
    assert rows(tables.merged(spark)) == rows(plan(57))
    before = rows(tables.merged(spark))
    tables.publish(of_weeks(data, weeks[56:]), weeks[56:])
    assert rows(tables.merged(spark)) == before


def test_a_week_without_rows_loses_its_partition(spark, inputs, tmp_path):
    weeks, data = inputs
    tables = WeeklyTables(f"{tmp_path}/weekly", W.AS_OF, W.AFTER_WEEK)
    tables.publish(data, weeks[-2:])
    tables.publish(of_weeks(data, []), weeks[-1:])
    assert {r.week for r in tables.merged(spark).select("week").distinct().collect()} == {weeks[-2]}
    assert tables._weeks(spark) == [weeks[-2]]


def test_nothing_published(spark, tmp_path):
    with pytest.raises(ValueError):
        WeeklyTables(f"{tmp_path}/none", W.AS_OF, W.AFTER_WEEK).merged(spark)


def test_folded_rows_are_kept_as_parquet(spark, inputs, tmp_path, monkeypatch):
    """No copy of the folded rows as serialised objects, and no staged copy that stays."""
    from aislemetrics.plans import publishing

    staged = []
    path = publishing.scratch_path
    monkeypatch.setattr(publishing, "materialize", lambda df: pytest.fail("checkpoint of folded rows"))
    monkeypatch.setattr(publishing, "scratch_path", lambda spark, kind: staged.append(path(spark, kind)) or staged[-1])
    weeks, data = inputs
    WeeklyTables(f"{tmp_path}/weekly", W.AS_OF, W.AFTER_WEEK).publish(data, weeks[-1:])
    assert len(staged) == 4 and not any(publishing.path_exists(spark, p) for p in staged)
