import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foreband.functions.dates import parse_day_and_hour
from foreband.operators import evaluate as E
from foreband.operators import frames as R
from foreband.operators import ordered as O
from foreband.operators import timegrid as G

DAY = dt.date(2020, 1, 1)


def price_frame(spark, n=500, gaps=True, seed=1):
    rnd = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        for i in range(n):
            if not gaps or rnd.random() < 0.7:
                rows.append((s, DAY + dt.timedelta(days=i), 50 + rnd.random() * 100))
    return spark.createDataFrame(rows, "series_id string, date date, price double").repartition(5)


@pytest.mark.parametrize("block_rows", [5, 7, 64, 4096])
def test_blocked_lags_equal_plain_windows(spark, block_rows):
    px = O.with_position(price_frame(spark), ["series_id"], "date", days=30)
    w = Window.partitionBy("series_id").orderBy("date")
    want = px.withColumns({"rn": F.row_number().over(w), "l1": F.lag("price", 1).over(w), "l5": F.lag("price", 5).over(w)})
    got = O.with_lags(px, ["series_id"], {"g1": ("price", 1), "g5": ("price", 5)}, block_rows)
    both = want.join(got.select("series_id", "date", "g1", "g5"), ["series_id", "date"])
    assert both.count() == px.count() == got.count()
    bad = both.filter((F.col("rn") != F.col("pos")) | ~F.col("l1").eqNullSafe(F.col("g1")) | ~F.col("l5").eqNullSafe(F.col("g5")))
    assert bad.count() == 0


def test_halo_on_both_sides(spark):
    px = O.with_position(price_frame(spark, 50, gaps=False), ["series_id"], "date")
    blocks = O.into_blocks(px, 2, 3, 10).filter("series_id = 'a'")
    got = {r["block"]: sorted(r["p"]) for r in blocks.groupBy("block").agg(F.collect_list("pos").alias("p")).collect()}
    assert got[0] == list(range(1, 14)) and got[1] == list(range(9, 24)) and got[4] == list(range(39, 51))
    assert blocks.filter("own").count() == 50


def test_returns_by_hand(spark):
    px = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), p) for i, p in enumerate([100.0, 110.0, 121.0])], "series_id string, date date, price double")
    px = O.with_position(px, ["series_id"], "date")
    log = [r["ret2"] for r in O.with_returns(px, ["series_id"], (2,)).orderBy("date").collect()]
    assert log[:2] == [None, None] and log[2] == pytest.approx(100 * math.log(1.21))
    exact = [r["ret1"] for r in O.with_returns(px, ["series_id"], (1,), "exact").orderBy("date").collect()]
    assert exact[0] is None and exact[1:] == pytest.approx([10.0, 10.0])


def test_cumulative_return_stays_within_a_week(spark):
    rows = [("s", DAY + dt.timedelta(days=i), 1.0) for i in range(20)]
    rets = spark.createDataFrame(rows, "series_id string, date date, ret1 double")
    got = O.cumulative_return(rets, ["series_id"], [DAY, DAY + dt.timedelta(days=5)]).groupBy("origin").agg(F.max("ret"), F.min("date")).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [
        (DAY, 7.0, DAY + dt.timedelta(days=1)),
        (DAY + dt.timedelta(days=5), 7.0, DAY + dt.timedelta(days=6)),
    ]


def test_time_folds_by_hand(spark):
    df = spark.range(100).select(F.lit("s").alias("k"), (F.col("id") + 1).alias("pos"), F.lit(100).alias("n_rows"))
    got = O.time_folds(df, 3, 10).groupBy("fold", "part").agg(F.min("pos"), F.max("pos")).collect()
    assert {(r[0], r[1]): (r[2] - 1, r[3]) for r in got} == {
        (0, "train"): (0, 70), (0, "test"): (70, 80), (1, "train"): (0, 80), (1, "test"): (80, 90), (2, "train"): (0, 90), (2, "test"): (90, 100),
    }


def test_skip_first_and_best_by(spark):
    px = price_frame(spark, 30, gaps=False)
    left = O.skip_first(px, ["series_id"], "date", 4)
    assert left.agg(F.min("date")).first()[0] == DAY + dt.timedelta(days=4) and left.count() == 52
    best = O.best_by(px, ["series_id"], "price").collect()
    want = {r[0]: r[1] for r in px.groupBy("series_id").agg(F.min("price")).collect()}
    assert {r["series_id"]: r["price"] for r in best} == want
    # numbers are compared as numbers
    bic = spark.createDataFrame([("s", 1, 900.0), ("s", 2, 1000.0)], "k string, p int, bic double")
    assert O.best_by(bic, ["k"], "bic").first()["p"] == 1


def test_hourly_sums_fill_gaps(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 0, 15), 1.0), ("s", dt.datetime(2024, 1, 1, 0, 45), 2.0), ("s", dt.datetime(2024, 1, 1, 3, 0), 4.0), ("s", dt.datetime(2024, 1, 1, 2, 0), None)]
    raw = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    got = [r["value"] for r in G.hourly_sums(raw, ["series_id"]).orderBy("ts").collect()]
    assert got == [3.0, 0.0, 0.0, 4.0]
    got = [r["value"] for r in G.hourly_sums(raw, ["series_id"], gap="null").orderBy("ts").collect()]
    assert got == [3.0, None, None, 4.0]


def test_time_lookup_is_keyed_by_time(spark):
    px = price_frame(spark, 60)
    got = G.with_time_lookups(px, ["series_id"], {"back": "7 days"}, ts="date", value="price", horizon="3 days")
    b = px.select("series_id", F.date_add("date", 7).alias("date"), F.col("price").alias("want"))
    both = got.join(b, ["series_id", "date"], "left")
    assert both.count() == px.count() and both.filter(~F.col("back").eqNullSafe(F.col("want"))).count() == 0
    with pytest.raises(ValueError):
        G.with_time_lookups(px, ["series_id"], {"back": "2 days"}, ts="date", value="price", horizon="3 days")


def test_time_lookup_refuses_duplicates_and_keeps_rows_without_a_time(spark):
    rows = [("a", dt.date(2024, 1, 1), 1.0), ("a", None, 2.0), ("a", None, 3.0), ("a", dt.date(2024, 1, 8), None)]
    df = spark.createDataFrame(rows, "series_id string, date date, price double")
    got = G.with_time_lookups(df, ["series_id"], {"back": "7 days"}, ts="date", value="price")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*r, 1.0 if r[1] == dt.date(2024, 1, 8) else None) for r in rows], key=str)
    with pytest.raises(Exception, match="more than one row"):
        G.with_time_lookups(df.union(df), ["series_id"], {"back": "7 days"}, ts="date", value="price").collect()


def test_tasks_of_a_lookup_grow_with_its_rows(spark, monkeypatch):
    days = spark.range(60).select((F.col("id") % 7).alias("series_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("value"))
    plain = G.with_time_lookups(days, ["series_id"], {"lag7": "7 days"}, ts="date")
    monkeypatch.setattr(G.dealt, "__defaults__", (10,))
    many = G.with_time_lookups(days, ["series_id"], {"lag7": "7 days"}, ts="date", rows=60)
    assert many.select(F.spark_partition_id()).distinct().count() > 8  # the session has 8 shuffle partitions
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, plain.collect()), key=lambda r: r[:2])


def test_hours_and_parsing_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        texts = spark.createDataFrame([("31.03.2024", "02:30"), ("31.03.2024", "03:10"), ("31.03.2024", None)], "d string, h string")
        parsed = texts.select(F.lit("a").alias("series_id"), parse_day_and_hour(F.col("d"), F.col("h")).alias("ts"), F.lit(2.0).alias("value"))
        assert [r[0] for r in parsed.select(F.col("ts").cast("string")).collect()] == ["2024-03-31 02:30:00", "2024-03-31 03:10:00", None]
        sums = G.hourly_sums(parsed, ["series_id"]).select(F.col("ts").cast("string"), "value").orderBy("ts").collect()
        assert [tuple(r) for r in sums] == [("2024-03-31 02:00:00", 2.0), ("2024-03-31 03:00:00", 2.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_levels_there_and_back(spark):
    df = spark.createDataFrame([("s", [1.0, 5.0, 4.0, 6.0, 7.0])], "k string, q array<double>")
    wide = R.levels_to_columns(R.explode_levels(df, "q"), ["k"])
    assert wide.select("q0_025", "q0_5", "q0_975").first()[:] == (1.0, 4.0, 7.0)
    assert R.levels_to_rows(wide, ["k"]).filter("tau = 0.5").first()["q"] == 4.0
    assert R.unpack_levels(R.monotone(df, "q"), "q").select("q0_25", "q0_5").first()[:] == (4.0, 5.0)


def test_scores_join_by_key_and_sum_five_levels(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("m", "s", day.date(), day, 1, t, 10.0, 8.0 + i) for i, t in enumerate((0.025, 0.25, 0.5, 0.75, 0.975))]
    fc = spark.createDataFrame(rows, "model string, series_id string, origin date, ts timestamp_ntz, horizon int, tau double, y double, q double")
    r = E.wide_scores(E.score(fc)).first()
    assert r["sum_qs"] == pytest.approx(5 * r["mean_qs"])
    assert r["qs0_025"] == pytest.approx(2 * 0.025 * 2)
    actuals = spark.createDataFrame([("s", 1, 5.0), ("s", 3, 7.0)], "k string, t int, y double")
    preds = spark.createDataFrame([("s", 3, 70.0), ("s", 2, 60.0)], "k string, t int, q double")
    got = {r["t"]: r["q"] for r in R.forecasts_with_actuals(actuals, preds, ["k", "t"]).collect()}
    assert got == {1: None, 3: 70.0}


def test_sorted_levels_never_score_worse(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.gauss(0, 1), [rnd.gauss(0, 1) for _ in range(5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y double, q array<double>")
    mean = lambda d: E.score(R.explode_levels(d, "q")).groupBy("id").agg(F.sum("qs").alias("s"))
    both = mean(df).join(mean(R.monotone(df, "q")).withColumnRenamed("s", "t"), "id")
    assert both.filter("t > s + 1e-12").count() == 0


def test_grid_has_every_combination(spark):
    got = spark.range(1).select(F.inline(R.grid(p=[1, 2, 3], q=[4, 5], r=[0.1]))).collect()
    assert len(got) == len({tuple(r) for r in got}) == 6


def test_results_do_not_depend_on_partitions(spark):
    px = price_frame(spark)
    out = []
    for n in (1, 7):
        rets = O.with_returns(O.with_position(px.repartition(n), ["series_id"], "date"), ["series_id"], block_rows=16)
        out.append(sorted(rets.select("series_id", "date", "ret5").collect(), key=str))
    assert out[0] == out[1]
