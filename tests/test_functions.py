import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aislemetrics.functions import columns as cols
from aislemetrics.functions.aggregates import correlation, describe, key_of_max, variation
from aislemetrics.functions.pvalues import f_pvalue, incomplete_beta, t_pvalue
from aislemetrics.functions import running
from aislemetrics.functions.running import cumulative_share, quantiles, running_totals


def one(df):
    return df.collect()[0]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (5.01,), (15.0,), (50.0,), (50.1,), (None,)], "x double")
    got = [r[0] for r in df.select(cols.bins(F.col("x"), (0, 5, 15, 50, None), ("a", "b", "c", "d"))).collect()]
    assert got == [None, None, "a", "b", "b", "c", "d", None]


def test_ratio_guards_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (1.0, 4.0)], "a double, b double")
    got = df.select(cols.ratio(F.col("a"), F.col("b"), 100.0, 0.0).alias("r"), cols.ratio(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["r"] for r in got] == [0.0, 0.0, 25.0] and [r["n"] for r in got] == [None, None, 0.25]


def test_small_expressions(spark):
    row = one(
        spark.range(1).select(
            cols.price_cents(F.lit(4.35)).alias("cents"),
            cols.clean_upc(F.lit("000120 3BP1BP2")).alias("upc"),
            cols.short_week_text(F.lit(202405)).alias("week"),
            cols.is_value(F.lit(None).cast("string"), "A").alias("flag"),
            cols.cycle_week(F.lit(52)).alias("c0"),
            cols.cycle_week(F.lit(52), one_based=True).alias("c1"),
            cols.modelled_category(F.lit(7)).alias("cat"),
            cols.equalised(F.lit(2.0), F.lit(0.0)).alias("same"),
            cols.equalised(F.lit(2.0), F.lit(3.0)).alias("times"),
        )
    )
    assert row.asDict() == {
        "cents": 35, "upc": "12003", "week": "12405", "flag": False, "c0": 0, "c1": 52,
        "cat": "Apparel", "same": 2.0, "times": 6.0,
    }


def test_coercion_and_roles(spark):
    df = spark.createDataFrame([("1.5", "x", "2024-01-02"), ("bad", "y", "no")], "price_amt string, name string, day string")
    out = cols.coerce_dates(cols.coerce_numeric(df, ["price_amt", "absent"]), ["day"])
    assert [r["price_amt"] for r in out.collect()] == [1.5, None]
    assert [r["day"] is None for r in out.collect()] == [False, True]
    assert cols.numeric_columns(out) == ["price_amt"] and cols.text_columns(out) == ["name"]
    assert cols.columns_named(out, "price", "amt") == ["price_amt"]
    with pytest.raises(ValueError):
        cols.require(df, "nope")


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_totals_equal_a_plain_sum(spark, partitions):
    rng = np.random.default_rng(3)
    # a third of all rows share one value
    values = np.where(rng.random(5000) < 0.34, 7.0, rng.integers(0, 500, 5000)).astype(float)
    pdf = pd.DataFrame({"k": np.arange(5000), "x": values})
    df = spark.createDataFrame(pdf).repartition(partitions)
    got = cumulative_share(df, "k", "x").toPandas().sort_values("position")
    want = pdf.sort_values(["x", "k"], ascending=[False, True])
    assert got["k"].tolist() == want["k"].tolist()
    assert np.allclose(got["cum_value"], want["x"].cumsum())
    assert got["position"].tolist() == list(range(1, 5001))


def test_running_totals_use_many_ranges_when_not_coalesced(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(1000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"))
        got = running_totals(df, ["k"], {"n": F.lit(1)}).toPandas().sort_values("k")
        assert got["n_running"].tolist() == list(range(1, 1001)) and set(got["n_total"]) == {1000}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cumulative_share_edges(spark):
    share = lambda rows: {r["k"]: r["cum_pct"] for r in cumulative_share(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect()}
    assert share([("a", 80.0), ("b", 20.0)]) == {"a": 80.0, "b": 100.0}
    assert share([("a", 90.0), ("b", 10.0)])["a"] == 90.0  # alone above 80: no top class
    assert share([("a", 0.0)]) == {"a": None}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 6, 3000)), "x": rng.normal(size=3000).round(2)})
    df = spark.createDataFrame(pdf)
    got = quantiles(df, "x", [0.1, 0.5, 0.99], ["a", "b", "c"], ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g].tolist(), np.quantile(part["x"], [0.1, 0.5, 0.99]))
    whole = one(quantiles(df, "x", [0.25, 0.75]))
    assert np.allclose([whole["q25"], whole["q75"]], np.quantile(pdf["x"], [0.25, 0.75]))


@pytest.mark.parametrize("small, accuracy", [(0, 50), (0, 1000), (100, 200)])
def test_quantiles_by_selection(spark, monkeypatch, small, accuracy):
    """Brackets that hold few rows, ties over bracket ends, a group of one value, hot and tiny groups."""
    monkeypatch.setattr(running, "SMALL", small)
    monkeypatch.setattr(running, "ACCURACY", accuracy)
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": np.where(rng.random(6000) < 0.5, 0, rng.integers(1, 5, 6000)), "x": rng.gamma(0.3, 100, 6000).round(1)})
    pdf.loc[pdf["g"] == 3, "x"] = 7.5
    pdf = pd.concat([pdf, pd.DataFrame({"g": [9, 10, 10], "x": [1.0, -2.0, 5.0]})])
    df = spark.createDataFrame(pdf).repartition(5).union(spark.createDataFrame([(0, None), (11, None)], "g long, x double"))
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = quantiles(df, "x", probs, ["a", "b", "c", "d", "e"], ["g"]).toPandas().set_index("g")
    assert set(got.index) == set(pdf["g"])
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g].tolist(), np.quantile(part["x"], probs))
    assert np.allclose(list(one(quantiles(df, "x", probs, list("abcde")))), np.quantile(pdf["x"], probs))


def test_selection_sorts_and_writes_no_column(spark):
    df = spark.range(100_000).select((F.col("id") % 7).alias("g"), F.xxhash64("id").cast("double").alias("x"))
    for got in (quantiles(df, "x", [0.5]), quantiles(df, "x", [0.5], by=["g"], groups=7)):
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan and "CartesianProduct" not in plan
    candidates = running._candidates(df.select(F.col("x").alias("_v")), [0.5], [], None)
    assert 1 < candidates.where("_c is not null").count() < 200


def test_aggregates_on_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 5.0, 1.0), (None, 9.0, 9.0)], "g string, x double, y double")
    got = {r["g"]: r for r in df.groupBy("g").agg(correlation(F.col("x"), F.col("y")).alias("r"), variation("x").alias("cv")).collect()}
    assert got["a"]["r"] is None and got["b"]["cv"] is None
    assert one(df.where("g is not null").groupBy("g").agg(F.sum("y").alias("y")).agg(key_of_max("g", "y").alias("k")))["k"] == "a"
    tie = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "g string, y double")
    assert one(tie.agg(key_of_max("g", "y").alias("k")))["k"] == "a"


def test_describe_counts_values_only(spark):
    row = one(describe(spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double"), ["x"]))
    assert (row["n"], row["mean"], row["q50"]) == (2, 2.0, 2.0)


def test_beta_against_closed_forms():
    assert np.isclose(incomplete_beta(1.0, 1.0, 0.3), 0.3)
    assert np.isclose(incomplete_beta(2.0, 2.0, 0.25), 3 * 0.25**2 - 2 * 0.25**3)
    assert np.isclose(incomplete_beta(0.5, 0.5, 0.5), 0.5)


def test_pvalues_against_tables(spark):
    row = one(
        spark.range(1).select(
            t_pvalue(F.lit(2.228), F.lit(10)).alias("t10"),
            t_pvalue(F.lit(-1.0), F.lit(1)).alias("cauchy"),
            f_pvalue(F.lit(4.964), F.lit(1), F.lit(10)).alias("f"),
            t_pvalue(F.lit(None).cast("double"), F.lit(3)).alias("none"),
        )
    )
    assert abs(row["t10"] - 0.05) < 1e-4 and abs(row["cauchy"] - 0.5) < 1e-12 and abs(row["f"] - 0.05) < 1e-4
    assert row["none"] is None
