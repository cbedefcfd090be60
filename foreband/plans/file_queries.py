"""Queries over landed files and sinks: each writes files from the tables, reads them back, and removes them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foreband.core import cut, scratch
from foreband.functions import dates as D
from foreband.functions.calendar import daylight_hours, holidays
from foreband.models import linear as L
from foreband.models import passes as P
from foreband.operators import evaluate as E
from foreband.operators import timegrid as G
from foreband.operators.timegrid import with_time_lookups
from foreband.plans import catalog as C
from foreband.plans.baseline import baseline, load_origins
from foreband.plans.catalog import query, with_
from foreband.plans.score_queries import Q, submission
from foreband.plans.series_queries import SERIES, price_years, r6
from foreband.sources import landed, published, sinks
from foreband.sources.series import daily_prices, hourly_load, table

SCORES = ["qs0_025", "qs0_25", "qs0_5", "qs0_75", "qs0_975", "mean_qs", "sum_qs"]


@query(
    "s1_decimal_comma_files",
    with_(C.LOAD) + "SELECT ts, round(round(value, 2) / 1000, 6) AS value FROM load_h WHERE series_id = 'view'",
)
def s1_files(spark, root):
    with scratch(spark, "decimal") as path:
        sinks.write_decimal_comma_load(hourly_load(spark, root).filter("series_id = 'view'"), path)
        return cut(landed.read_decimal_comma_load(spark, path).select("ts", r6("value")))


@query(
    "s2_json_chunk_files",
    with_(C.LOAD)
    + """SELECT ts + INTERVAL 1 HOUR AS ts, round(value, 6) AS value FROM load_h
WHERE series_id = 'view' AND date_trunc('week', ts) > (SELECT min(date_trunc('week', ts)) FROM load_h WHERE series_id = 'view')""",
)
def s2_files(spark, root):
    with scratch(spark, "chunks") as path:
        sinks.write_json_chunks(hourly_load(spark, root).filter("series_id = 'view'"), path)
        return cut(landed.read_json_chunks(spark, path, "Europe/Berlin", skip_chunks=1).select("ts", r6("value")))


@query(
    "s4_price_files",
    with_(C.PRICES) + "SELECT series_id, date, round(price, 6) AS price FROM px WHERE series_id = '2-HIGH' AND date BETWEEN DATE '1995-01-01' AND DATE '1999-06-30'",
)
def s4_files(spark, root):
    with scratch(spark, "prices") as path:
        daily_prices(spark, root).select(F.col("series_id").alias("symbol"), "date", F.col("price").alias("adjusted")).write.parquet(path)
        read = landed.read_prices(spark, path, "2-HIGH", dt.date(1995, 1, 1), dt.date(1999, 6, 30))
        return cut(read.select("series_id", "date", r6("price")))


@query(
    "s5_holiday_file",
    with_(C.HOLIDAYS) + "SELECT CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS place, date FROM holidays",
)
def s5(spark, root):
    """The sorted holiday file, with each date's line."""
    with scratch(spark, "holidays") as path:
        sinks.write_holidays(holidays(spark, *price_years(spark, root)), path)
        return cut(landed.read_holidays(spark, path).select((F.monotonically_increasing_id() + 1).cast("int").alias("place"), "date"))


DAYLIGHT_SQL = """, light AS (SELECT date, 24 / pi() * acos(greatest(-1, least(1, (sin(radians(-0.833)) - sin(radians(51.1657)) * sin(decl))
    / (cos(radians(51.1657)) * cos(decl))))) AS daylight
FROM (SELECT date, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g)
        - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl
      FROM (SELECT DISTINCT CAST(ts AS DATE) AS date, (dayofyear(ts) - 1) * 2 * pi() / 365 AS g FROM load_h)))"""


@query(
    "j2_daylight_join",
    with_(C.LOAD)
    + DAYLIGHT_SQL
    + """SELECT series_id, ts, round(value, 6) AS value, round(daylight, 6) AS daylight FROM load_h JOIN light ON light.date = CAST(ts AS DATE)
WHERE day(light.date) % 7 != 0""",
)
def j2(spark, root):
    """Load with the daylight of a file that lacks every seventh day of a month: an inner join drops those."""
    load = hourly_load(spark, root)
    days = load.select(F.to_date("ts").alias("date")).distinct()
    with scratch(spark, "daylight") as path:
        days.filter("day(date) % 7 != 0").select("date", daylight_hours(F.col("date")).alias("daylight")).write.csv(path, header=True)
        light = landed.read_daylight(spark, path)
        return cut(load.withColumn("date", F.to_date("ts")).join(light, "date", "inner").select("series_id", "ts", r6("value"), r6("daylight")))


def with_week(spark, root, rows):
    """Number of the origin among all weekly ones, from 1."""
    known = F.array(*[F.lit(o) for o in load_origins(spark, root)])
    return rows.withColumn("week", F.array_position(known, F.col("origin")).cast("int"))


@query(
    "s7_weekly_submissions",
    with_(C.FORECASTS)
    + """SELECT CAST(dense_rank() OVER (ORDER BY origin) AS INTEGER) AS week, strftime(origin, '%Y%m%d') AS forecast_date, model, series_id,
  CAST(horizon AS VARCHAR) || ' hour' AS horizon, """
    + ", ".join(f"round({c} + 1e-11, 6) AS {c}" for c in Q)
    + " FROM wide_q WHERE isodow(ts) IN (5, 6) AND hour(ts) IN (12, 16, 20)",
)
def s7(spark, root):
    """One submission a week, written in one job and read back through one glob."""
    rows = submission(baseline(spark, root), "energy").withColumn("origin", F.to_date("forecast_date", "yyyyMMdd"))
    with scratch(spark, "weekly") as path:
        sinks.write_weekly(with_week(spark, root, rows).drop("origin"), path)
        schema = "forecast_date string, target string, model string, series_id string, horizon string, " + ", ".join(f"{c} double" for c in Q)
        back = landed.read_weekly(spark, f"{path}/week=*", schema)
        return cut(back.select("week", "forecast_date", "model", "series_id", "horizon", *[F.round(F.col(c) + 1e-11, 6).alias(c) for c in Q]))


@query(
    "s8_actuals_file",
    with_(C.FORECASTS)
    + """SELECT ts, CAST(ts AS DATE) AS date, round(value, 6) AS value FROM load_h
WHERE series_id = 'click' AND ts IN (SELECT ts FROM fc WHERE isodow(ts) IN (5, 6) AND hour(ts) IN (12, 16, 20))""",
)
def s8(spark, root):
    """Actual values of the target hours, from a file of all hours."""
    times = baseline(spark, root).filter(D.in_target_hours(F.col("ts"))).select("ts").distinct()
    with scratch(spark, "actuals") as path:
        one = hourly_load(spark, root).filter("series_id = 'click'")
        one.select(F.col("ts").cast("string").alias("date_time"), "value").write.csv(path, header=True)
        return cut(landed.read_actuals(spark, path, times).select("ts", "date", r6("value")))


@query(
    "k3_published_weeks",
    with_(C.FORECASTS)
    + """, last AS (SELECT max(origin) AS o FROM fc)
SELECT model, origin, count(*) AS n, round(sum(q + CASE WHEN origin = o AND model = 'lag7' THEN 1 ELSE 0 END), 4) AS total_q FROM fc, last GROUP BY 1, 2""",
)
def k3_weeks(spark, root):
    """All weeks published, one week of one model published again with other values: readers find the second run only, and the first run's others."""
    rows = cut(baseline(spark, root))
    last = load_origins(spark, root)[-1]
    with scratch(spark, "published") as path:
        published.publish(rows, path)
        published.publish(rows.filter((F.col("origin") == F.lit(last)) & (F.col("model") == "lag7")).withColumn("q", F.col("q") + 1), path)
        back = published.read_published(spark, path, rows.schema)
        return cut(back.groupBy("model", "origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("q"), 4).alias("total_q")))


@query(
    "k3_score_files",
    with_(C.FORECASTS)
    + "SELECT model, origin, "
    + ", ".join(f"round(avg({c}) + 1e-11, 6) AS {c}" for c in SCORES)
    + ", count(*) AS n FROM wide WHERE isodow(ts) IN (5, 6) AND hour(ts) IN (12, 16, 20) GROUP BY 1, 2",
)
def k3_scores(spark, root):
    """Scores of all hours and of the target hours as two sinks; the mean of the second."""
    wide = cut(E.wide_scores(E.score(baseline(spark, root))))
    with scratch(spark, "scores") as path:
        sinks.write_scores(wide, f"{path}/all")
        sinks.write_scores(wide.filter(D.in_target_hours(F.col("ts"))), f"{path}/target")
        back = spark.read.schema(wide.schema).parquet(f"{path}/target")
        means = E.column_means(back, ["model", "origin"], SCORES).select("model", "origin", *[F.round(F.col(c) + 1e-11, 6).alias(c) for c in SCORES])
        return cut(means.join(back.groupBy("model", "origin").agg(F.count(F.lit(1)).alias("n")), ["model", "origin"]))


@query(
    "k4_parameter_files",
    with_(C.LAGS)
    + """SELECT series_id, 'intercept' AS term, round(regr_intercept(value, lag7), 6) AS coef FROM lagged GROUP BY 1
UNION ALL SELECT series_id, 'slope', round(regr_slope(value, lag7), 6) FROM lagged GROUP BY 1""",
)
def k4(spark, root):
    """Coefficients of a regression, written and read back."""
    lagged = with_time_lookups(hourly_load(spark, root), SERIES, {"lag7": "7 days"})
    blocks = P.run(P.feature_blocks(lagged, SERIES, "ts", "value", [F.lit(1.0), F.col("lag7")], 16))
    with scratch(spark, "parameters") as path:
        sinks.write_parameters(L.ols(blocks, SERIES, ["intercept", "slope"]), path)
        return cut(spark.read.parquet(path).select("series_id", "term", r6("coef")))


@query(
    "u2_history_and_trend",
    with_(C.LOAD)
    + """, daily AS (SELECT series_id, CAST(ts AS DATE) AS date, sum(value) AS value FROM load_h GROUP BY 1, 2),
ends AS (SELECT series_id, max(date) AS last FROM daily GROUP BY 1),
ahead AS (SELECT d.series_id, CAST(last + k AS DATE) AS date, trend
          FROM (SELECT d.series_id, last, avg(value) AS trend FROM daily d JOIN ends e ON e.series_id = d.series_id AND date > last - 7 GROUP BY 1, 2) d, (SELECT unnest([1, 2, 3]) AS k))
SELECT series_id, date, round(value, 6) AS value, NULL::DOUBLE AS trend FROM daily UNION ALL SELECT series_id, date, NULL, round(trend, 6) FROM ahead""",
)
def u2(spark, root):
    """Daily sums, and for the three days after them the mean of the last week; the column that either lacks is null there."""
    daily = cut(G.daily_sums(hourly_load(spark, root), SERIES))
    ends = daily.groupBy(*SERIES).agg(F.max("date").alias("last"))
    trend = daily.join(ends, SERIES).filter(F.col("date") > F.date_sub("last", 7)).groupBy(*SERIES, "last").agg(F.avg("value").alias("trend"))
    ahead = trend.select(*SERIES, F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", 3))).alias("date"), "trend")
    return daily.unionByName(ahead, allowMissingColumns=True).select(*SERIES, "date", r6("value"), r6("trend"))
