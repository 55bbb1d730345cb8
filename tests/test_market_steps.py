"""The market feed is sent as few times as its keys change, and only the weeks that are attached."""

from pyspark.sql import functions as F

from aislemetrics.plans import price_gap as pg

MAP = [("EAST", "7", "70"), ("EAST", "8", "80"), ("EAST", "8", "81"), ("WEST", "7", "70"), (None, "7", "71"), ("EAST", None, "72")]


def feed(spark, folder, weeks=(9501, 9502)):
    """Regions in two spellings and missing, a UPC without own UPC, a missing UPC and one that is all zeros."""
    rows = [
        (w, r, f"{r} {lv}", "1 w/e", u, "4")
        for w in weeks for r in ("east", "East", "west", None) for lv in ("ALL CHANNELS", "HG_MART") for u in ("0007BP1", "0008BP1", "0009", None, "00")
    ]
    df = spark.createDataFrame(rows, "promo_yr_wk int, region string, market_description string, period_description string, upc string, sales string")
    df.withColumn("market_description", F.coalesce("market_description", F.lit("x ALL CHANNELS"))).withColumns(
        {m: F.col("sales") for m in pg.MEASURES if m != "sales"}
    ).write.parquet(str(folder / "feed"))
    spark.createDataFrame(MAP, "region string, market_upc string, own_upc string").write.parquet(str(folder / "map"))
    return spark.read.parquet(str(folder / "feed")), spark.read.parquet(str(folder / "map"))


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]


def same(a, b):
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_feed_placed_for_the_map_is_sent_once(spark, tmp_path):
    market, upc_map = feed(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = pg.market_clean(market, for_map=True)
        clean = pg.market_clean(market)
        assert same(clean, placed.drop("_region"))
        assert same(pg.market_mapped(clean, upc_map), pg.market_mapped(placed, upc_map).drop("_region"))
        assert same(pg.market_shared(clean, upc_map), pg.market_shared(placed, upc_map))
        # the feed's exchange and the map's; for the levels and what follows, one more by own UPC
        duplicated = pg.market_duplicates(pg.market_mapped(placed, upc_map))
        assert len(exchanges(duplicated)) == 2
        levels = pg.market_levels(pg.market_split(duplicated))
        assert "Expand" not in levels._jdf.queryExecution().optimizedPlan().toString()
        by_level = pg.market_by_level(levels)
        by_own = [line for line in exchanges(by_level) if "own_upc" in line]
        assert by_own and all("hashpartitioning(promo_yr_wk" in line and "region" not in line.split("hashpartitioning")[1].split(")")[0] for line in by_own)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_duplicates_count_for_each_spelling(spark, tmp_path):
    market, upc_map = feed(spark, tmp_path)
    mapped = pg.market_mapped(pg.market_clean(market), upc_map)
    counts = mapped.groupBy("region", "market_upc").agg(F.count_distinct("own_upc").alias("own_upcs"))
    counts = counts.select(F.upper("region").alias("_region"), "market_upc", "own_upcs")
    want = mapped.withColumn("_region", F.upper("region")).join(counts, ["_region", "market_upc"], "left")
    want = want.withColumn("own_upcs", F.coalesce("own_upcs", F.lit(0))).drop("_region")
    got = pg.market_duplicates(mapped)
    assert got.columns == want.columns and got.dtypes == want.dtypes and same(got, want)
    assert {r.own_upcs for r in got.collect()} == {0, 1, 2}


def test_levels_add_the_regions(spark, tmp_path):
    market, upc_map = feed(spark, tmp_path)
    split = pg.market_split(pg.market_shared(pg.market_clean(market), upc_map))
    keys = ["promo_yr_wk", "market_description", "period_description", "own_upc"]
    both = split.groupingSets([["region", *keys], keys], "region", *keys).agg(F.grouping("region").alias("g"), *[F.sum(m).alias(m) for m in pg.MEASURES])
    want = both.withColumn("region", F.when(F.col("g") == 1, pg.NATIONAL).otherwise(F.col("region"))).drop("g")
    assert same(want, pg.market_levels(split))


def test_only_weeks_with_own_sales_are_sent(spark, tmp_path):
    market, upc_map = feed(spark, tmp_path, weeks=(9450, 9501, 9502, 9610))
    volume = spark.createDataFrame([(199501, "east", "70", 1.0, 1.0), (199502, "WEST", "70", 1.0, 1.0), (199502, pg.NATIONAL, "70", 2.0, 2.0)], "week int, region string, upc_nbr string, own_sales double, own_units double")
    volume = volume.select("*", *[F.lit("x").alias(k) for k in pg.ITEM_KEYS if k != "upc_nbr"])
    kept = pg.market_of_own_items(market, upc_map, volume)
    assert {r.promo_yr_wk for r in kept.select("promo_yr_wk").distinct().collect()} == {9501, 9502}
    whole, part = (pg.attach_market(volume, pg.market_pivot(pg.market_clean(f, for_map=True), upc_map)) for f in (market, kept))
    assert same(whole, part)
    assert pg.market_of_own_items(market, upc_map, volume.limit(0)).isEmpty()


def test_prices_are_joined_where_groups_were_summed(spark):
    attached = spark.createDataFrame([(199501, r, "1") for r in ("east", "East", None, "west")], "week int, region string, upc_nbr string")
    attached = attached.select("*", *[F.lit("x").alias(k) for k in pg.GROUP_KEYS], *[F.lit(1.0).alias(m) for m in (*pg.MARKET_READ, "own_sales", "own_units")])
    own, competitor = (spark.createDataFrame([(199501, "EAST", "x", 1.0, 2.0)], f"week int, region string, group_code string, {a} double, {b} double") for a, b in (("own_live", "own_reg"), ("comp_live", "comp_reg")))
    plain, placed = (pg.attach_prices(pg.roll_up_upcs(attached, for_prices=p), own, competitor) for p in (False, True))
    assert plain.columns[1:] == placed.columns[1:] and same(plain, placed) and plain.where("own_live = 1").count() == 2


def stages(clean, upc_map, parts=None, single=False):
    """Levels and the two pivots over them, without the place of their rows."""
    levels = pg.market_levels(pg.market_split(pg.market_shared(clean, upc_map, parts, single=single)), parts)
    by_level = pg.market_by_level(levels)
    return [df.drop("_place") for df in (levels, by_level, pg.market_by_period(by_level))]


def test_rows_of_an_own_upc_with_one_market_upc_are_sent_once(spark, tmp_path):
    market, _ = feed(spark, tmp_path)
    market = market.union(market.withColumn("region", F.lit(pg.NATIONAL)))  # a region of that name is not the total
    # 70 has two market UPCs, 80 and 81 one, in two regions; one row comes twice, and one has no own UPC
    rows = [("EAST", "7", "70"), ("WEST", "8", "80"), ("EAST", "8", "80"), ("EAST", "8", "81"), ("EAST", "8", "81"), ("EAST", "9", "70"), ("West", "9", None), (pg.NATIONAL, "7", "70"), (None, "7", "71")]
    upc_map = spark.createDataFrame(rows, "region string, market_upc string, own_upc string")
    plain, placed = pg.market_clean(market), pg.market_clean(market, for_map=True, parts=3)
    flagged = pg.market_shared(placed, upc_map, 3, single=True)
    assert {(r.own_upc, r._single) for r in flagged.where("own_upc is not null").collect()} == {("70", False), ("80", True), ("81", True)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for want, got in zip(stages(plain, upc_map), stages(placed, upc_map, 3, single=True)):
            assert same(want, got) and want.count() == got.count()
            sent = [line for line in exchanges(got) if "_place" in line or "own_upc" in line and "REPARTITION" in line]
            assert len(sent) == 1 and "hashpartitioning(_place" in sent[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_of_the_feed_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    market, upc_map = feed(spark, tmp_path)
    monkeypatch.setattr(pg, "FEED_ROWS", 5)
    plan = pg.PriceGapPlan(pg.PriceGapInputs(*[None] * 6, market, upc_map, None, None), None, 0, "", "")
    assert plan.parts == 16  # 80 rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (plan.clean, plan.mapped, plan.duplicated, plan.shared, plan.split, plan.levels, plan.by_level, plan.by_period, plan.pivoted, plan.market_read):
            tall = [line for line in exchanges(df) if "REPARTITION" in line]
            assert tall and all(", 16), REPARTITION_BY_NUM" in line for line in tall)
        assert same(plan.mapped, pg.market_mapped(plan.clean, upc_map)) and same(plan.shared, pg.market_shared(plan.clean, upc_map))
        assert same(plan.duplicated, pg.market_duplicates(plan.mapped))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pivot_needs_only_what_it_reads(spark, tmp_path):
    market, upc_map = feed(spark, tmp_path)
    every = spark.createDataFrame([(p,) for p in ("1 w/e", "4 w/e", "52 w/e")], "period_description string")
    market = market.drop("period_description").crossJoin(every)
    market = market.withColumns({"sales": F.when(F.col("period_description") != "1 w/e", "4").otherwise("0"), "promo_units": F.lit("9")})
    part = pg.market_measures_read(market)
    assert part.where("promo_units is not null and period_description <> '1 w/e'").isEmpty() and "units_ya" not in part.columns
    few = pg.market_clean(part, for_map=True, measures=pg.READ_MEASURES)
    want = pg.market_pivot(pg.market_clean(market), upc_map)
    assert want.count() > 0 and same(want, pg.market_pivot(few, upc_map))
