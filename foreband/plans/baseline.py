"""Seasonal-lag quantile forecasts over many origins: the reference point for every model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreband import LEVELS
from foreband.functions.dates import horizon_hours
from foreband.operators.frames import explode_levels, split_at_origins
from foreband.operators.timegrid import time_bounds, with_time_lookups
from foreband.sources.series import hourly_load, raw_load

DAYS_AHEAD = 3
LOOKBACKS = {"lag7": "7 days", "lag14": "14 days"}


def weekly_origins(first: dt.date, last: dt.date, history_days: int, days_ahead: int, weekday: int = 2) -> list[dt.date]:
    """Wednesdays (by default) with enough history before and enough days after them."""
    day = first + dt.timedelta(days=history_days)
    day += dt.timedelta(days=(weekday - day.weekday()) % 7)
    out = []
    while day + dt.timedelta(days=days_ahead) <= last:
        out.append(day)
        day += dt.timedelta(days=7)
    return out


def load_origins(spark: SparkSession, root: str) -> list[dt.date]:
    first, last = time_bounds(raw_load(spark, root))
    return weekly_origins(first.date(), last.date(), 8, DAYS_AHEAD)


def seasonal_forecasts(
    load: DataFrame, origins: list, lookbacks: dict[str, str] = LOOKBACKS, days_ahead: int = DAYS_AHEAD, levels=LEVELS
) -> DataFrame:
    """Forecast = the value one season earlier plus a quantile of the seasonal differences before the origin.

    Returns long forecasts with actuals: model, series_id, origin, ts, horizon, tau, y, q.
    """
    parts = split_at_origins(
        with_time_lookups(load, ["series_id"], lookbacks, horizon=f"{days_ahead} days"), origins, days_ahead
    )
    models = [F.struct(F.lit(m).alias("model"), F.col(m).alias("ref")) for m in lookbacks]
    rows = parts.select("series_id", "origin", "part", "ts", "value", F.inline(F.array(*models))).filter("ref IS NOT NULL")
    keys = ["model", "series_id", "origin"]
    spread = (
        rows.filter("part = 'train'")
        .groupBy(*keys)
        .agg(F.percentile(F.col("value") - F.col("ref"), F.array(*[F.lit(t) for t in levels])).alias("d"))
    )
    cases = rows.filter("part = 'test'").join(spread, keys).select(
        *keys,
        "ts",
        horizon_hours(F.col("origin"), F.col("ts")).alias("horizon"),
        F.col("value").alias("y"),
        F.transform("d", lambda x: F.col("ref") + x).alias("q"),
    )
    return explode_levels(cases, "q", levels)


def baseline(spark: SparkSession, root: str, gap: str = "zero") -> DataFrame:
    return seasonal_forecasts(hourly_load(spark, root, gap), load_origins(spark, root))
