"""Registry of the named queries and, where SQL can say the same, their SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from foreband.core import ship
from foreband.functions.calendar import EASTER_OFFSETS, FIXED_HOLIDAYS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")


        @wraps(fn)
        def ready(spark: SparkSession, root: str) -> DataFrame:
            ship(spark)
            return fn(spark, root)

        QUERIES[name] = ready
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Common table expressions of the SQL side.

LOAD = """
raw AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2),
span AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM raw GROUP BY 1),
spine AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span),
load_h AS (SELECT s.series_id, s.ts, coalesce(r.v, 0) AS value
           FROM spine s LEFT JOIN raw r ON s.series_id = r.series_id AND s.ts = r.ts)"""

LAGS = (
    LOAD
    + """,
lagged AS (SELECT a.series_id, a.ts, a.value, b.value AS lag7, c.value AS lag14
           FROM load_h a
           LEFT JOIN load_h b ON b.series_id = a.series_id AND b.ts = a.ts - INTERVAL 7 DAY
           LEFT JOIN load_h c ON c.series_id = a.series_id AND c.ts = a.ts - INTERVAL 14 DAY)"""
)

ORIGINS = """
origins AS (SELECT CAST(d AS DATE) AS origin
            FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE) + INTERVAL 8 DAY,
                                                CAST(max(ts) AS DATE) - INTERVAL 3 DAY, INTERVAL 1 DAY)) AS d FROM events)
            WHERE isodow(d) = 3)"""

FORECASTS = (
    LAGS
    + ","
    + ORIGINS
    + """,
refs AS (SELECT 'lag7' AS model, series_id, ts, value, lag7 AS ref FROM lagged WHERE lag7 IS NOT NULL
         UNION ALL
         SELECT 'lag14', series_id, ts, value, lag14 FROM lagged WHERE lag14 IS NOT NULL),
levels AS (SELECT unnest([0.025, 0.25, 0.5, 0.75, 0.975]::DOUBLE[]) AS tau),
spread AS (SELECT model, series_id, origin, tau,
                  CASE tau WHEN 0.025 THEN p[1] WHEN 0.25 THEN p[2] WHEN 0.5 THEN p[3] WHEN 0.75 THEN p[4] ELSE p[5] END AS d
           FROM (SELECT model, series_id, origin,
                        quantile_cont(value - ref, [0.025, 0.25, 0.5, 0.75, 0.975]) AS p
                 FROM refs JOIN origins ON CAST(ts AS DATE) <= origin GROUP BY 1, 2, 3), levels),
fc AS (SELECT r.model, r.series_id, s.origin, r.ts,
              CAST((date_diff('day', s.origin, CAST(r.ts AS DATE)) - 1) * 24 + hour(r.ts) AS INTEGER) AS horizon,
              s.tau, r.value AS y, r.ref + s.d AS q
       FROM refs r JOIN spread s ON s.model = r.model AND s.series_id = r.series_id
        AND CAST(r.ts AS DATE) > s.origin AND CAST(r.ts AS DATE) <= s.origin + 3),
sc AS (SELECT *, 2 * greatest(tau * (y - q), (tau - 1) * (y - q)) AS qs FROM fc),
wide AS (SELECT model, series_id, origin, ts, horizon,
                max(CASE WHEN tau = 0.025 THEN qs END) AS qs0_025, max(CASE WHEN tau = 0.25 THEN qs END) AS qs0_25,
                max(CASE WHEN tau = 0.5 THEN qs END) AS qs0_5, max(CASE WHEN tau = 0.75 THEN qs END) AS qs0_75,
                max(CASE WHEN tau = 0.975 THEN qs END) AS qs0_975, sum(qs) / 5 AS mean_qs, sum(qs) AS sum_qs
         FROM sc GROUP BY 1, 2, 3, 4, 5),
wide_q AS (SELECT model, series_id, origin, ts, horizon, max(y) AS y,
                max(CASE WHEN tau = 0.025 THEN q END) AS q0_025, max(CASE WHEN tau = 0.25 THEN q END) AS q0_25,
                max(CASE WHEN tau = 0.5 THEN q END) AS q0_5, max(CASE WHEN tau = 0.75 THEN q END) AS q0_75,
                max(CASE WHEN tau = 0.975 THEN q END) AS q0_975
         FROM fc GROUP BY 1, 2, 3, 4, 5)"""
)

PRICES = """
px AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price
       FROM orders GROUP BY 1, 2)"""

RETURNS = (
    PRICES
    + """,
rets AS (SELECT series_id, date, price,
                100 * (ln(price) - ln(lag(price, 1) OVER w)) AS ret1, 100 * (ln(price) - ln(lag(price, 2) OVER w)) AS ret2,
                100 * (ln(price) - ln(lag(price, 3) OVER w)) AS ret3, 100 * (ln(price) - ln(lag(price, 4) OVER w)) AS ret4,
                100 * (ln(price) - ln(lag(price, 5) OVER w)) AS ret5
         FROM px WINDOW w AS (PARTITION BY series_id ORDER BY date))"""
)

PRICE_ORIGINS = """
price_origins AS (SELECT CAST(d AS DATE) AS origin
                  FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE) + INTERVAL 366 DAY,
                               CAST(max(o_orderdate) AS DATE) - INTERVAL 7 DAY, INTERVAL 1 DAY)) AS d FROM orders)
                  WHERE isodow(d) = 3)"""

HOLIDAYS = f"""
years AS (SELECT unnest(generate_series(CAST(year(min(o_orderdate)) AS INTEGER), CAST(year(max(o_orderdate)) AS INTEGER) + 1)) AS y
          FROM orders),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS e FROM e4),
holidays AS (SELECT CAST(e + k AS DATE) AS date FROM easter, (VALUES {", ".join(f"({k})" for k in EASTER_OFFSETS)}) AS o(k)
             UNION ALL
             SELECT make_date(y, m, d) FROM easter, (VALUES {", ".join(f"({m}, {d})" for m, d in FIXED_HOLIDAYS)}) AS f(m, d))"""

WEEKDAY_NAMES = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"
MONTH_NAMES = (
    "['January','February','March','April','May','June','July','August','September','October','November','December']"
)


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
