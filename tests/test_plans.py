import datetime as dt

from pyspark.sql import functions as F

from foreband.plans import model_queries, series_queries
from foreband.plans.baseline import seasonal_forecasts, weekly_origins
from foreband.plans.load_forecast import trend_frame


def test_weekly_origins_are_wednesdays_with_history_and_future():
    got = weekly_origins(dt.date(2023, 11, 1), dt.date(2023, 12, 1), 8, 3)
    assert got == [dt.date(2023, 11, 15), dt.date(2023, 11, 22)]


def hourly(spark, days=28):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(hours=h), float(100 + h % 168 + h // 24)) for h in range(24 * days)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


def test_seasonal_forecasts_know_nothing_after_the_origin(spark):
    origin = dt.date(2024, 1, 17)
    load = hourly(spark)
    changed = load.withColumn("value", F.when(F.to_date("ts") > origin, -1e6).otherwise(F.col("value")))
    q = lambda df: sorted(r[:] for r in seasonal_forecasts(df, [origin]).select("model", "ts", "tau", "q").collect())
    assert q(load) == q(changed)
    rows = seasonal_forecasts(load, [origin]).filter("model = 'lag7' AND tau = 0.5")
    assert rows.count() == 72
    # the series rises by one a day
    assert rows.filter(F.abs(F.col("y") - F.col("q")) > 1e-9).count() == 0


def test_trend_knows_nothing_after_the_origin(spark):
    origins = [dt.date(2024, 1, 17), dt.date(2024, 1, 24)]
    load = hourly(spark)
    trend = trend_frame(load, origins)
    ends = {r[0]: r[1] for r in trend.groupBy("origin").agg(F.max("date")).collect()}
    assert ends == {o: o + dt.timedelta(days=3) for o in origins}
    changed = load.withColumn("value", F.when(F.to_date("ts") > origins[0], 0.0).otherwise(F.col("value")))
    pick = lambda t: [r["trend"] for r in t.filter(F.col("origin") == origins[0]).orderBy("date").collect()]
    assert pick(trend) == pick(trend_frame(changed, origins))


def test_f3_forecasts_for_every_weekly_origin(spark, root, monkeypatch):
    asked = []
    monkeypatch.setattr(model_queries.I, "arma_garch_forecasts", lambda prices, origins, *a, **b: asked.append(origins))
    model_queries.f3(spark, root)
    assert asked == [series_queries.price_origins(spark, root)] and len(asked[0]) > 12
