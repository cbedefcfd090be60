"""Hourly load: features, trend, quantile regression and boosted quantiles for many origins in one job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreband import LEVELS
from foreband.functions.calendar import daylight_hours, holidays
from foreband.functions.dates import horizon_hours, with_calendar
from foreband.models import boost as B
from foreband.models import ets
from foreband.models import linear as L
from foreband.models import passes as P
from foreband.models.stl import stl
from foreband.operators.frames import attach, explode_levels, split_at_origins, with_holiday_flag
from foreband.operators.ordered import with_position
from foreband.operators.timegrid import daily_sums, time_bounds, with_time_lookups

SERIES = ["series_id"]
LAGS = {"lag1": "7 days", "lag2": "14 days", "lag3": "364 days"}
BOOST_FEATURES = (
    "dayofyear", "hour", "dayofweek", "quarter", "month", "year", "lag1", "lag2", "lag3", "daylight", "is_holiday",
)
DAYS_AHEAD = 3


def load_features(spark: SparkSession, load: DataFrame, lags: dict[str, str] = LAGS) -> DataFrame:
    """Calendar, time-keyed lags, daylight and holiday flag; every lag is known three days ahead."""
    first, last = time_bounds(load)
    lagged = with_time_lookups(load, SERIES, lags, horizon=f"{DAYS_AHEAD} days")
    days = with_calendar(lagged).withColumn("daylight", daylight_hours(F.col("date")))
    return with_holiday_flag(days, holidays(spark, first.year, last.year))


# ---- linear quantile regression with a forecast trend


def trend_frame(load: DataFrame, origins: list, n_ahead: int = DAYS_AHEAD) -> DataFrame:
    """Daily trend per origin: decomposed up to the origin, smoothed forward after it.

    Keys series_id, origin, date; nothing after an origin enters its trend.
    """
    keys = ["series_id", "origin"]
    train = split_at_origins(load, origins, 0)
    daily = with_position(daily_sums(train, keys), keys, "date")
    parts = P.run(stl(daily, keys, "date", "value"))
    blocks = ets.trend_blocks(parts, keys, "trend")
    ahead = ets.forecast(blocks, P.run(ets.fit(blocks, keys)), keys, n_ahead)
    last = parts.groupBy(*keys).agg(F.max("date").alias("_last"))
    future = ahead.join(last, keys).select(*keys, F.date_add("_last", F.col("step")).alias("date"), F.col("value").alias("trend"))
    return parts.select(*keys, "date", "trend").unionByName(future)


def regression_terms(df: DataFrame) -> tuple[list[Column], dict[str, list[int]]]:
    """Regressors of the load and the columns each term owns; the constant comes first."""
    terms = {
        "trend": [F.col("trend")],
        "month": L.dummies(F.col("month"), range(1, 13)),
        "weekday": L.dummies(F.col("dayofweek"), range(7)),
        "hour": L.dummies(F.col("hour"), range(24)),
        "is_holiday": [F.col("is_holiday")],
        "daylight": [F.col("daylight")],
    }
    columns, owned = [F.lit(1.0)], {}
    for name, cols in terms.items():
        owned[name] = list(range(len(columns), len(columns) + len(cols)))
        columns += cols
    return columns, owned


def regression_frame(spark: SparkSession, load: DataFrame, origins: list) -> DataFrame:
    features = split_at_origins(load_features(spark, load, {"lag1": "7 days"}), origins, DAYS_AHEAD)
    return P.cut(attach(features, P.run(trend_frame(load, origins)), ["series_id", "origin", "date"]))


def regression_forecasts(spark: SparkSession, load: DataFrame, origins: list, levels=LEVELS, rounds: int = 20) -> DataFrame:
    """Long forecasts of the load regression for every origin."""
    keys = ["series_id", "origin"]
    frame = regression_frame(spark, load, origins)
    columns, _ = regression_terms(frame)
    blocks = P.run(P.feature_blocks(frame.filter("part = 'train'"), keys, "ts", "value", columns))
    coefs = L.quantile_regression(blocks, keys, len(columns), levels, rounds)
    cases = L.predict_levels(frame.filter("part = 'test'"), coefs, keys, columns, levels).select(
        F.lit("quantile_regression").alias("model"),
        *keys,
        "ts",
        horizon_hours(F.col("origin"), F.col("ts")).alias("horizon"),
        F.col("value").alias("y"),
        "q",
    )
    return explode_levels(cases, "q", levels)


# ---- boosted quantiles


def day_number(day: dt.date) -> float:
    return float((day - dt.date(1970, 1, 1)).days)


def boost_blocks(spark: SparkSession, load: DataFrame, clock: Column | None = None, span_days: int = 32) -> DataFrame:
    """Coded blocks of the load features; the clock counts days unless another one is given."""
    frame = P.cut(load_features(spark, load))
    columns = [F.col(c) for c in BOOST_FEATURES]
    clock = clock if clock is not None else F.unix_date("date")
    return B.coded_blocks(frame, SERIES, "ts", "value", clock, columns, B.feature_edges(frame, SERIES, columns), span_days)


def origin_specs(origins: list[dt.date], levels=LEVELS, depth: int = 3, rate: float = 0.1) -> list[B.Spec]:
    return [B.Spec(t, depth, rate, day_number(o), day_number(o) + DAYS_AHEAD) for o in origins for t in levels]


def boosted_forecasts(spark: SparkSession, load: DataFrame, origins: list, levels=LEVELS, rounds: int = 200) -> DataFrame:
    """Long forecasts of boosted trees; all origins and levels are boosted in the same passes."""
    specs = origin_specs(origins, levels)
    model = B.fit(boost_blocks(spark, load), SERIES, list(BOOST_FEATURES), specs, rounds)
    rows = B.prediction_rows(model.blocks, SERIES, specs)
    owner = F.array(*[F.lit(o) for o in origins])
    origin = F.element_at(owner, (F.floor(F.col("model_no") / F.lit(len(levels))) + 1).cast("int"))
    return rows.withColumn("origin", origin).select(
        F.lit("boosted").alias("model"),
        "series_id",
        "origin",
        "ts",
        horizon_hours(F.col("origin"), F.col("ts")).alias("horizon"),
        "tau",
        "y",
        "q",
    )


# ---- search over settings with expanding folds


def folds_within(load: DataFrame, folds: int, test_rows: int) -> int:
    """`folds`, or as many test stretches as leave the shortest series one stretch at least to learn from."""
    shortest = load.groupBy(*SERIES).count().agg(F.min("count")).first()[0] or 0
    return max(1, min(folds, shortest // test_rows - 1))


def grid_search(
    spark: SparkSession,
    load: DataFrame,
    folds: int,
    test_rows: int,
    depths=(3, 5),
    rates=(0.01, 0.1),
    trees=(200, 500),
    levels=LEVELS,
) -> DataFrame:
    """Fold scores of every setting: series_id, tau, depth, rate, trees, fold, score (negated doubled pinball).

    The clock counts rows back from the end of the series, so fold i of k trains on clocks up to
    -(k - i) * test_rows. Settings that differ only in the number of trees share one run.
    """
    placed = with_position(load, SERIES, "ts")
    clock = P.cut(placed.select("series_id", "ts", (F.col("pos") - F.col("n_rows")).cast("double").alias("clock")))
    frame = P.cut(load_features(spark, load).join(clock, ["series_id", "ts"]))
    columns = [F.col(c) for c in BOOST_FEATURES]
    blocks = B.coded_blocks(
        frame, SERIES, "ts", "value", F.col("clock"), columns, B.feature_edges(frame, SERIES, columns), 32
    )
    cases = [(t, d, r, f) for t in levels for d in depths for r in rates for f in range(folds)]
    specs = [
        B.Spec(t, d, r, -float((folds - f) * test_rows), -float((folds - f - 1) * test_rows)) for t, d, r, f in cases
    ]
    model = B.fit(blocks, SERIES, list(BOOST_FEATURES), specs, max(trees), tuple(trees))
    settings = F.array(
        *[
            F.struct(F.lit(t).alias("tau"), F.lit(d).alias("depth"), F.lit(r).alias("rate"), F.lit(f).alias("fold"))
            for t, d, r, f in cases
        ]
    )
    out = None
    for n in trees:
        scored = B.test_losses(model.snapshots[n], SERIES, specs).select(
            "series_id",
            F.element_at(settings, F.col("model_no") + 1).alias("s"),
            F.lit(n).alias("trees"),
            (-F.col("loss")).alias("score"),
        )
        out = scored if out is None else out.unionByName(scored)
    return out.select("series_id", "s.tau", "s.depth", "s.rate", "trees", "s.fold", "score")
