"""Checked sketches: hot dimensions are not gathered in one task, and odd rows count as before."""

from pyspark.sql import functions as F

from aislemetrics.functions import sketches
from aislemetrics.sources.files import bucket_count
from workload import tables


def frame(spark):
    rows = [(w, s, i % 40 if i % 7 else None, float(i % 100) if i % 11 else None) for w in (199901, 200002, None) for s in (1, 2, None) for i in range(300)]
    return spark.createDataFrame(rows + [(199901, 3, 5, 1.0)], "week int, store int, item int, amount double")


def test_checked_figures(spark, monkeypatch):
    df = frame(spark)
    dims = {"all": F.lit("all"), "store": F.col("store"), "year": F.floor(F.col("week") / 100)}
    stored = sketches.states(df, ["week", "store"], {"item": "item"}, {"amount": "amount"})
    frames = []
    for parts in (1000, 2):  # every dimension hot; the whole and the larger half only
        monkeypatch.setattr(sketches, "HOT_PARTS", parts)
        frames.append({(r.level, r.dimension): r for r in sketches.checked(df, stored, dims, "item", "amount").collect()})
    assert frames[0] == frames[1] and set(frames[0]) == {("all", "all"), ("store", "1"), ("store", "2"), ("store", "3"), ("year", "1999"), ("year", "2000")}
    for (level, dimension), r in frames[0].items():
        of = {"all": df, "store": df.where(F.col("store") == dimension), "year": df.where(F.floor(F.col("week") / 100) == dimension)}[level]
        assert r.exact == of.select("item").dropna().distinct().count() and r.within
    assert frames[0]["all", "all"].rows == 1201


def test_ranks_of_a_hot_dimension_are_not_shuffled(spark):
    """The look-up of the middle by the dimension of all rows is a broadcast, whatever the session's threshold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = frame(spark)
        stored = sketches.states(df, ["week", "store"], {"item": "item"}, {"amount": "amount"})
        out = sketches.checked(df, stored, {"all": F.lit("all")}, "item", "amount").select("level", "dimension", "middle_within")
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_counts_take_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(sketches, "TASK_ROWS", 100)
    df = frame(spark)
    stored = sketches.states(df, ["week", "store"], {"item": "item"}, {"amount": "amount"})
    out = sketches.checked(df, stored, {"all": F.lit("all")}, "item", "amount")
    assert "item" in (text := out._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in text


def test_buckets_follow_the_rows():
    """36 million rows, as in 60 times sf0.1, are folded in pieces of about a million at most."""
    rows = 36_000_000
    assert rows / bucket_count(rows, 40, tables.BUCKET_BYTES) < 1 << 20
