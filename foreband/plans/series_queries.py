"""Queries over sources, features, joins and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.functions import dates as D
from foreband.functions.calendar import business_days_after, daylight_hours, holidays
from foreband.functions.numbers import format_decimal_comma, parse_decimal_comma
from foreband.operators import evaluate as E
from foreband.operators import frames as R
from foreband.operators import ordered as O
from foreband.operators import timegrid as G
from foreband.plans import catalog as C
from foreband.plans.baseline import load_origins, weekly_origins
from foreband.plans.catalog import query, with_
from foreband.plans.index_forecast import future_days
from foreband.sources.series import daily_prices, daily_volumes, hourly_load, raw_load, table

SERIES = ["series_id"]


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def price_origins(spark, root: str) -> list:
    first, last = G.time_bounds(table(spark, root, "orders"), "o_orderdate")
    return weekly_origins(first.date(), last.date(), 366, 7)


def price_years(spark, root: str) -> tuple[int, int]:
    first, last = G.time_bounds(table(spark, root, "orders"), "o_orderdate")
    return first.year, last.year + 1


def price_returns(spark, root: str) -> DataFrame:
    return O.with_returns(O.with_position(daily_prices(spark, root), SERIES, "date"), SERIES)


# ---- sources


@query(
    "s1_decimal_comma_load",
    with_(C.LOAD)
    + "SELECT series_id, ts, CAST(ts AS DATE) AS date, round(round(value, 2) / 1000, 6) AS value FROM load_h",
)
def s1(spark, root):
    text = hourly_load(spark, root).select(
        "series_id",
        F.date_format("ts", "dd.MM.yyyy").alias("Datum"),
        F.date_format("ts", "HH:mm").alias("Anfang"),
        format_decimal_comma(F.col("value")).alias("amount"),
    )
    parsed = text.select(
        "series_id",
        D.parse_day_and_hour(F.col("Datum"), F.col("Anfang")).alias("ts"),
        F.to_date("Datum", "dd.MM.yyyy").alias("date"),
        (parse_decimal_comma(F.col("amount")) / 1000).alias("value"),
    )
    return parsed.filter("value IS NOT NULL").select("series_id", "ts", "date", r6("value"))


@query(
    "s2_json_series_explode",
    with_(C.LOAD)
    + """SELECT series_id, ts + INTERVAL 1 HOUR AS ts, round(value, 6) AS value
FROM load_h JOIN (SELECT series_id AS sid, min(date_trunc('week', ts)) AS w0 FROM load_h GROUP BY 1) f ON sid = series_id
WHERE date_trunc('week', ts) > w0""",
)
def s2(spark, root):
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    pair = F.array(D.utc_to_epoch_ms(F.col("ts")).cast("double"), F.col("value"))
    chunks = (
        hourly_load(spark, root)
        .groupBy("series_id", week.alias("chunk"))
        .agg(F.to_json(F.struct(F.sort_array(F.collect_list(pair)).alias("series"))).alias("text"))
    )
    later = O.skip_first(chunks, SERIES, "chunk", 1)
    parsed = later.select("series_id", F.from_json("text", "series array<array<double>>").alias("doc"))
    rows = parsed.select("series_id", F.explode("doc.series").alias("p")).select(
        "series_id",
        D.epoch_ms_to_local(F.element_at("p", 1), "Europe/Berlin").alias("ts"),
        F.element_at("p", 2).alias("value"),
    )
    return rows.filter("value IS NOT NULL").select("series_id", "ts", r6("value"))


@query(
    "s4_price_window",
    with_(C.PRICES)
    + "SELECT date, round(price, 6) AS price FROM px WHERE series_id = '1-URGENT' AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
)
def s4(spark, root):
    wanted = table(spark, root, "orders").filter(
        (F.col("o_orderpriority") == "1-URGENT")
        & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    )
    return wanted.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 6).alias("price"))


# ---- projections and filters


@query(
    "p4_null_policy",
    with_(C.RETURNS)
    + """SELECT series_id, count(*) AS n_rows,
  sum(CASE WHEN ret1 IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null_ret1, sum(CASE WHEN ret5 IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null_ret5,
  max(CASE WHEN ret1 IS NULL THEN 1 ELSE 0 END) = 1 AS any_null_ret1, max(CASE WHEN ret5 IS NULL THEN 1 ELSE 0 END) = 1 AS any_null_ret5,
  sum(CASE WHEN ret1 IS NOT NULL AND ret2 IS NOT NULL AND ret3 IS NOT NULL AND ret4 IS NOT NULL AND ret5 IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_complete,
  round(avg(coalesce(ret5, 0)), 6) AS mean_filled FROM rets GROUP BY 1""",
)
def p4(spark, root):
    rets = price_returns(spark, root)
    full = R.drop_if_any_null(rets, [f"ret{h}" for h in range(1, 6)]).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_complete"))
    filled = rets.fillna(0.0, ["ret5"]).groupBy("series_id").agg(F.round(F.avg("ret5"), 6).alias("mean_filled"))
    return R.null_report(rets, SERIES, ["ret1", "ret5"]).join(full, "series_id", "left").join(filled, "series_id")


@query(
    "p7_origin_split",
    with_(C.LOAD, C.ORIGINS)
    + """SELECT series_id, origin, CASE WHEN CAST(ts AS DATE) <= origin THEN 'train' ELSE 'test' END AS part,
  count(*) AS n, round(sum(value), 6) AS total, min(ts) AS first_ts, max(ts) AS last_ts
FROM load_h JOIN origins ON CAST(ts AS DATE) <= origin + 3 GROUP BY 1, 2, 3""",
)
def p7(spark, root):
    parts = R.split_at_origins(hourly_load(spark, root), load_origins(spark, root), 3)
    return parts.groupBy("series_id", "origin", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 6).alias("total"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@query(
    "p8_target_hours",
    with_(C.LOAD, C.ORIGINS)
    + """SELECT series_id, origin, ts, CAST((date_diff('day', origin, CAST(ts AS DATE)) - 1) * 24 + hour(ts) AS VARCHAR) || ' hour' AS horizon,
  round(value, 6) AS value
FROM load_h JOIN origins ON CAST(ts AS DATE) > origin AND CAST(ts AS DATE) <= origin + 3
WHERE isodow(ts) IN (5, 6) AND hour(ts) IN (12, 16, 20)""",
)
def p8(spark, root):
    parts = R.split_at_origins(hourly_load(spark, root), load_origins(spark, root), 3)
    hit = parts.filter((F.col("part") == "test") & D.in_target_hours(F.col("ts")))
    label = D.horizon_label(D.horizon_hours(F.col("origin"), F.col("ts")), "hour")
    return hit.select("series_id", "origin", "ts", label.alias("horizon"), r6("value"))


@query(
    "p11_holiday_flag",
    with_(C.PRICES, C.HOLIDAYS)
    + """SELECT series_id, date, round(price, 6) AS price, CASE WHEN date IN (SELECT date FROM holidays) THEN 1 ELSE 0 END AS is_holiday FROM px""",
)
def p11(spark, root):
    flagged = R.with_holiday_flag(daily_prices(spark, root), holidays(spark, *price_years(spark, root)))
    return flagged.select("series_id", "date", r6("price"), "is_holiday")


# ---- dates and calendars


@query(
    "d3_calendar_features",
    with_(C.LOAD)
    + f"""SELECT series_id, ts, round(value, 6) AS value, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS dayofweek,
  quarter(ts)::INTEGER AS quarter, month(ts)::INTEGER AS month, year(ts)::INTEGER AS year, dayofyear(ts)::INTEGER AS dayofyear,
  day(ts)::INTEGER AS dayofmonth, weekofyear(ts)::INTEGER AS weekofyear, CAST(ts AS DATE) AS date,
  {C.WEEKDAY_NAMES}[isodow(ts)] AS weekday_name, {C.MONTH_NAMES}[month(ts)] AS month_name FROM load_h""",
)
def d3(spark, root):
    return D.with_calendar(hourly_load(spark, root)).withColumns(
        {"value": r6("value"), "weekday_name": D.weekday_name(F.col("ts")), "month_name": D.month_name(F.col("ts"))}
    )


@query(
    "d7_date_formats",
    with_(C.PRICES)
    + """SELECT series_id, date, strftime(date, '%Y%m%d') AS compact, strptime(strftime(date, '%Y%m%d'), '%Y%m%d')::DATE AS parsed,
  strftime(date, '%d.%m.%Y') AS dotted FROM px""",
)
def d7(spark, root):
    compact = D.compact_date(F.col("date"))
    return daily_prices(spark, root).select(
        "series_id",
        "date",
        compact.alias("compact"),
        D.parse_compact_date(compact).alias("parsed"),
        F.date_format("date", "dd.MM.yyyy").alias("dotted"),
    )


@query(
    "d8_business_days",
    with_(C.PRICES, C.HOLIDAYS)
    + """, last_day AS (SELECT series_id, date AS origin FROM px WHERE isodow(date) = 3)
SELECT series_id, origin, date, CAST(row_number() OVER (PARTITION BY series_id, origin ORDER BY date) AS INTEGER) AS step,
  CAST(date_diff('day', origin, date) AS VARCHAR) || ' day' AS horizon
FROM (SELECT series_id, origin, CAST(origin + k AS DATE) AS date FROM last_day, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS k))
WHERE isodow(date) <= 5 AND date NOT IN (SELECT date FROM holidays)""",
)
def d8(spark, root):
    origins = daily_prices(spark, root).filter(F.weekday("date") == 2).select("series_id", F.col("date").alias("origin"))
    days = business_days_after(origins, SERIES, "origin", holidays(spark, *price_years(spark, root)))
    label = D.horizon_label(D.horizon_days(F.col("origin"), F.col("date")), "day")
    return days.select("series_id", "origin", "date", "step", label.alias("horizon"))


@query(
    "d8_trading_targets",
    with_(C.PRICES, C.PRICE_ORIGINS, C.HOLIDAYS)
    + """, days AS (SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP + INTERVAL 14 DAY, INTERVAL 1 DAY)) AS d FROM px)
          WHERE isodow(d) <= 5 AND CAST(d AS DATE) NOT IN (SELECT date FROM holidays)),
ahead AS (SELECT origin, date, row_number() OVER (PARTITION BY origin ORDER BY date) AS step FROM price_origins JOIN days ON date > origin AND date <= origin + 21)
SELECT a.origin, CAST(a.step AS INTEGER) AS step, a.date, CAST(a.date - a.origin AS INTEGER) AS horizon, count(p.price) AS n_prices
FROM ahead a LEFT JOIN px p ON p.date = a.date WHERE step <= 5 GROUP BY 1, 2, 3, 4""",
)
def d8_targets(spark, root):
    """The five trading days after every origin, 1, 2, 5, 6 and 7 days ahead unless holidays fall between, and the prices they have."""
    prices = daily_prices(spark, root)
    per_day = prices.groupBy("date").agg(F.count("price").alias("_n"))
    targets = future_days(prices, price_origins(spark, root))
    return targets.join(per_day, "date", "left").select("origin", "step", "date", "horizon", F.coalesce("_n", F.lit(0)).alias("n_prices"))


@query(
    "d10_holidays",
    with_(C.HOLIDAYS)
    + """SELECT h.date, (isodow(h.date) - 1)::INTEGER AS weekday, count(o.o_orderkey) AS n_orders
FROM holidays h LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = h.date GROUP BY 1, 2""",
)
def d10(spark, root):
    per_day = table(spark, root, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("o_orderkey").alias("_n"))
    days = holidays(spark, *price_years(spark, root))
    return days.join(per_day, "date", "left").select(
        "date", F.weekday("date").alias("weekday"), F.coalesce("_n", F.lit(0)).alias("n_orders")
    )


@query(
    "d11_daylight",
    with_(C.PRICES)
    + """SELECT date, round(24 / pi() * acos(greatest(-1, least(1, (sin(radians(-0.833)) - sin(radians(51.1657)) * sin(decl))
    / (cos(radians(51.1657)) * cos(decl))))), 6) AS daylight
FROM (SELECT date, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g)
        - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl
      FROM (SELECT DISTINCT date, (dayofyear(date) - 1) * 2 * pi() / 365 AS g FROM px))""",
)
def d11(spark, root):
    days = table(spark, root, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", F.round(daylight_hours(F.col("date")), 6).alias("daylight"))


# ---- joins


@query(
    "j3_history_forecast_frame",
    with_(C.RETURNS, C.HOLIDAYS)
    + """, ends AS (SELECT series_id, max(date) AS origin FROM px GROUP BY 1),
future AS (SELECT series_id, date FROM (SELECT series_id, CAST(origin + k AS DATE) AS date FROM ends, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS k))
           WHERE isodow(date) <= 5 AND date NOT IN (SELECT date FROM holidays)),
spine AS (SELECT series_id, date, 'history' AS part FROM px UNION ALL SELECT series_id, date, 'future' FROM future)
SELECT s.series_id, s.date, s.part, round(r.ret1, 6) AS ret1, round(r.ret5, 6) AS ret5
FROM spine s LEFT JOIN (SELECT * FROM rets WHERE ret5 IS NOT NULL) r ON r.series_id = s.series_id AND r.date = s.date""",
)
def j3(spark, root):
    rets = price_returns(spark, root)
    known = daily_prices(spark, root).select("series_id", "date", F.lit("history").alias("part"))
    ends = known.groupBy("series_id").agg(F.max("date").alias("origin"))
    days = business_days_after(ends, SERIES, "origin", holidays(spark, *price_years(spark, root)))
    future = days.select("series_id", "date", F.lit("future").alias("part"))
    features = rets.filter("ret5 IS NOT NULL").select("series_id", "date", "ret1", "ret5")
    frame = R.history_and_future(features, known, future, ["series_id", "date"])
    return frame.select("series_id", "date", "part", r6("ret1"), r6("ret5"))


@query(
    "j6_semi",
    with_(C.LOAD, C.ORIGINS)
    + """SELECT series_id, ts, round(value, 6) AS value FROM load_h
WHERE ts IN (SELECT CAST(origin AS TIMESTAMP) + h * INTERVAL 1 HOUR FROM origins, (SELECT unnest([60, 64, 68, 84, 88, 92]) AS h))""",
)
def j6(spark, root):
    load = hourly_load(spark, root)
    parts = R.split_at_origins(load, load_origins(spark, root), 3)
    wanted = parts.filter((F.col("part") == "test") & D.in_target_hours(F.col("ts"))).select("ts").distinct()
    return R.members(load, wanted, ["ts"]).select("series_id", "ts", r6("value"))


@query(
    "j7_time_lookup",
    with_(C.LAGS) + "SELECT series_id, ts, round(value, 6) AS value, round(lag7, 6) AS lag7, round(lag14, 6) AS lag14 FROM lagged",
)
def j7(spark, root):
    out = G.with_time_lookups(hourly_load(spark, root), SERIES, {"lag7": "7 days", "lag14": "14 days"}, horizon="3 days")
    return out.select("series_id", "ts", *[r6(c) for c in ("value", "lag7", "lag14")])


@query(
    "j7_year_lookup",
    with_(C.PRICES)
    + """SELECT a.series_id, a.date, round(a.price, 6) AS price, round(b.price, 6) AS lag364
FROM px a LEFT JOIN px b ON a.series_id = b.series_id AND b.date = CAST(a.date - INTERVAL 364 DAY AS DATE)""",
)
def j7_year(spark, root):
    out = G.with_time_lookups(daily_prices(spark, root), SERIES, {"lag364": "364 days"}, ts="date", value="price", horizon="7 days")
    return out.select("series_id", "date", r6("price"), r6("lag364"))


@query(
    "j9_grid",
    with_(C.PRICES)
    + """SELECT series_id, rate, depth, fold, n FROM (SELECT series_id, count(*) AS n FROM px GROUP BY 1),
  (SELECT unnest([0.01, 0.1]::DOUBLE[]) AS rate), (SELECT unnest([3, 5]) AS depth), (SELECT unnest([0, 1, 2, 3, 4]) AS fold)""",
)
def j9(spark, root):
    sizes = daily_prices(spark, root).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("series_id", "n", F.inline(R.grid(rate=[0.01, 0.1], depth=[3, 5], fold=[0, 1, 2, 3, 4])))


# ---- aggregates


@query(
    "a1_seasonal_profile",
    with_(C.LOAD)
    + f"""SELECT series_id, weekday, hour, {C.WEEKDAY_NAMES}[weekday + 1] AS weekday_name, round(avg(value), 6) AS mean_value, count(*) AS n
FROM (SELECT series_id, (isodow(ts) - 1)::INTEGER AS weekday, hour(ts)::INTEGER AS hour, value FROM load_h) GROUP BY 1, 2, 3""",
)
def a1(spark, root):
    prof = G.seasonal_profile(hourly_load(spark, root), SERIES, {"weekday": F.weekday("ts"), "hour": F.hour("ts")})
    names = F.element_at(F.array(*[F.lit(n) for n in D.WEEKDAY_NAMES]), F.col("weekday") + 1)
    return prof.select("series_id", "weekday", "hour", names.alias("weekday_name"), r6("mean_value"), "n")


@query(
    "a1_day_of_year_profile",
    with_(C.PRICES)
    + "SELECT series_id, dayofyear(date)::INTEGER AS day, round(avg(price), 6) AS mean_value, count(*) AS n FROM px GROUP BY 1, 2",
)
def a1_yday(spark, root):
    prof = G.seasonal_profile(daily_prices(spark, root), SERIES, {"day": F.dayofyear("date")}, "price")
    return prof.select("series_id", "day", r6("mean_value"), "n")


@query(
    "a2_daily_sum",
    with_(C.LOAD) + "SELECT series_id, CAST(ts AS DATE) AS date, round(sum(value), 6) AS value FROM load_h GROUP BY 1, 2",
)
def a2(spark, root):
    return G.daily_sums(hourly_load(spark, root), SERIES).select("series_id", "date", r6("value"))


@query("a3_resample_hourly", with_(C.LOAD) + "SELECT series_id, ts, round(value, 6) AS value FROM load_h")
def a3(spark, root):
    return hourly_load(spark, root).select("series_id", "ts", r6("value"))


@query(
    "a3_resample_null_gaps",
    with_(C.LOAD)
    + "SELECT s.series_id, s.ts, round(r.v, 6) AS value FROM spine s LEFT JOIN raw r ON s.series_id = r.series_id AND s.ts = r.ts",
)
def a3_null(spark, root):
    return hourly_load(spark, root, "null").select("series_id", "ts", r6("value"))


@query(
    "a11_boxplot",
    with_(C.LOAD)
    + """SELECT series_id, weekday, n, round(p[1], 6) AS minimum, round(p[2], 6) AS lower, round(p[3], 6) AS median,
  round(p[4], 6) AS upper, round(p[5], 6) AS maximum
FROM (SELECT series_id, (isodow(ts) - 1)::INTEGER AS weekday, count(*) AS n, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS p
      FROM load_h GROUP BY 1, 2)""",
)
def a11(spark, root):
    box = E.five_numbers(hourly_load(spark, root), ["series_id", F.weekday("ts").alias("weekday")], "value")
    cols = ["minimum", "lower", "median", "upper", "maximum"]
    return box.select("series_id", "weekday", "n", *[r6(c) for c in cols])


@query(
    "a12_histogram",
    with_(C.RETURNS)
    + """SELECT series_id, CAST(CASE WHEN ret1 < -300 THEN 0 WHEN ret1 >= 300 THEN 61 ELSE floor((ret1 + 300) / 10) + 1 END AS BIGINT) AS bin,
  count(*) AS n FROM rets WHERE ret1 IS NOT NULL GROUP BY 1, 2""",
)
def a12(spark, root):
    return E.histogram(price_returns(spark, root), SERIES, "ret1", -300.0, 300.0, 60)


@query(
    "a13_bounds",
    with_(C.LOAD)
    + "SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, CAST(date_diff('day', min(ts), max(ts)) AS INTEGER) AS days FROM load_h GROUP BY 1",
)
def a13(spark, root):
    ends = hourly_load(spark, root).groupBy("series_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    )
    return ends.withColumn("days", F.datediff("last_ts", "first_ts"))


@query(
    "a2_supplier_volumes",
    """WITH v AS (SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)
SELECT a.series_id, a.date, round(a.value, 4) AS value, round(b.value, 4) AS lag7 FROM v a
LEFT JOIN v b ON a.series_id = b.series_id AND b.date = CAST(a.date - INTERVAL 7 DAY AS DATE)""",
)
def a2_volumes(spark, root):
    rows = table(spark, root, "lineitem").count()
    out = G.with_time_lookups(daily_volumes(spark, root), SERIES, {"lag7": "7 days"}, ts="date", rows=rows)
    return out.select("series_id", "date", F.round("value", 4).alias("value"), F.round("lag7", 4).alias("lag7"))


# ---- windows


@query(
    "w1_returns",
    with_(C.PRICES)
    + "SELECT series_id, date, "
    + ", ".join(
        f"round(100 * (ln(price) - ln(lag(price, {h}) OVER w)), 6) AS ret{h}, "
        f"round(100 * (price - lag(price, {h}) OVER w) / lag(price, {h}) OVER w, 6) AS simple{h}"
        for h in range(1, 6)
    )
    + ", round(pow(100 * (ln(price) - ln(lag(price, 1) OVER w)), 2), 4) AS ret1_sqrd FROM px WINDOW w AS (PARTITION BY series_id ORDER BY date)",
)
def w1(spark, root):
    px = O.with_position(daily_prices(spark, root), SERIES, "date")
    steps = range(1, 6)
    p = F.col("price")
    lagged = O.with_lags(px, SERIES, {f"p{h}": ("price", h) for h in steps})
    return lagged.select(
        "series_id",
        "date",
        *[r6((F.log(p) - F.log(f"p{h}")) * 100, f"ret{h}") for h in steps],
        *[r6((p - F.col(f"p{h}")) * 100 / F.col(f"p{h}"), f"simple{h}") for h in steps],
        F.round(F.pow((F.log(p) - F.log("p1")) * 100, F.lit(2)), 4).alias("ret1_sqrd"),
    )


@query(
    "w3_lags",
    with_(C.RETURNS)
    + "SELECT series_id, date, "
    + ", ".join(f"round(pow(lag(ret1, {k}) OVER v, 2), 4) AS ret_sqrd_lag{k}" for k in range(1, 6))
    + " FROM rets WINDOW v AS (PARTITION BY series_id ORDER BY date)",
)
def w3(spark, root):
    out = O.with_squared_lags(price_returns(spark, root), SERIES)
    return out.select("series_id", "date", *[F.round(f"ret_sqrd_lag{k}", 4).alias(f"ret_sqrd_lag{k}") for k in range(1, 6)])


@query(
    "w4_cum_return",
    with_(C.RETURNS, C.PRICE_ORIGINS)
    + """SELECT series_id, origin, date, round(sum(ret1) OVER (PARTITION BY series_id, origin ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS ret
FROM rets JOIN price_origins ON date > origin AND date <= origin + 7""",
)
def w4(spark, root):
    out = O.cumulative_return(price_returns(spark, root), SERIES, price_origins(spark, root))
    return out.select("series_id", "origin", "date", r6("ret"))


@query(
    "w5_time_folds",
    with_(C.LOAD)
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM load_h)
SELECT series_id, fold, CASE WHEN pos > n - (5 - fold) * 24 THEN 'test' ELSE 'train' END AS part, count(*) AS n_rows,
  min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 6) AS total
FROM p, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) WHERE pos <= n - (4 - fold) * 24 GROUP BY 1, 2, 3""",
)
def w5(spark, root):
    folds = O.time_folds(O.with_position(hourly_load(spark, root), SERIES, "ts"), 5, 24)
    return folds.groupBy("series_id", "fold", "part").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.round(F.sum("value"), 6).alias("total"),
    )
