"""Regular time grids: resampling, daily sums, time-keyed lookups and seasonal profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.functions.dates import wall_clock, wall_seconds

# Rows that a task aggregates by keys that nearly every row has for itself.
TASK_ROWS = 500_000


def dealt(df: DataFrame, keys: list[str], rows: int, each: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys over so many tasks that each gets about `each` of the given number of rows, however large df is.

    An aggregate by these keys needs no further shuffle, and its memory in a task stays the same as df grows.
    """
    return df.repartition(max(1, math.ceil(rows / each)), *keys)


def hourly_sums(raw: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", gap: str = "zero") -> DataFrame:
    """Sum per hour with every hour between the first and the last one present.

    `gap` says what an empty hour holds: `zero` or `null`. The raw rows meet one aggregate, which combines
    before its shuffle; the grid rows join that aggregate as empty rows instead of through a join.
    """
    if gap not in ("zero", "null"):
        raise ValueError(f"unknown gap rule: {gap}")
    # Counted in wall-clock seconds, as truncation would pass through the session's zone.
    hour = wall_clock(F.floor(wall_seconds(F.col(ts)) / 3600) * 3600)
    rows = raw.filter(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*keys, hour.alias("ts"), F.col(value).cast("double").alias("value"))
    ends = rows.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    grid = ends.select(
        *keys,
        F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 HOUR"))).alias("ts"),
        F.lit(0.0 if gap == "zero" else None).cast("double").alias("value"),
    )
    return rows.unionByName(grid).groupBy(*keys, "ts").agg(F.sum("value").alias("value"))


def daily_sums(hourly: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return hourly.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.sum(value).alias("value"))


def with_time_lookups(
    df: DataFrame, keys: list[str], lookups: dict[str, str], ts: str = "ts", value: str = "value", horizon: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Value of the same series exactly one interval earlier, null where no such row exists.

    `lookups` maps the new column to an interval such as `7 days`. With `horizon` every interval must reach
    at least that far back, so that a feature is known when the forecast is made. Each row sends its value forward to the
    times that will ask for it, so all the lookups share one scan and one shuffle on (keys, time).
    `rows`, if the caller knows that df has no more, sets the number of tasks; otherwise the session's shuffle partitions do.
    A second row of the same keys and time is an error. Rows without a time all stay, with nulls for the lookups.
    """
    if horizon is not None:
        for name, back in lookups.items():
            if _hours(back) < _hours(horizon):
                raise ValueError(f"{name} looks back {back}, less than the horizon {horizon}")
    names = list(lookups)
    shape = df.schema[ts].dataType
    own = [c for c in df.columns if c not in (*keys, ts)]

    def copy(at, column):
        mine = column is None
        fields = [at.cast(shape).alias(ts)]
        fields += [(F.col(c) if mine else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in own]
        fields += [(F.col(value) if n == column else F.lit(None).cast(df.schema[value].dataType)).alias(n) for n in names]
        return F.struct(*fields, F.lit(mine).alias("_here"))

    copies = [copy(F.col(ts), None)]
    copies += [copy(F.col(ts) + F.expr(f"INTERVAL {back}"), name) for name, back in lookups.items()]
    # A number of its own keeps a row without a time apart from others.
    alone = F.when(F.col(ts).isNull(), F.monotonically_increasing_id()).otherwise(-1).alias("_alone")
    sent = df.select("*", alone).select(*keys, "_alone", F.inline(F.array(*copies))).filter(F.col("_here") | F.col(ts).isNotNull())
    if rows is not None:
        sent = dealt(sent, [*keys, ts, "_alone"], len(copies) * rows)
    met = sent.groupBy(*keys, ts, "_alone").agg(
        *[F.max(c).alias(c) for c in (*own, *names)], F.sum(F.col("_here").cast("int")).alias("_here")
    )
    twice = F.raise_error(F.concat(F.lit("more than one row at "), F.col(ts).cast("string")))
    return met.filter(F.when(F.col("_here") > 1, twice.cast("boolean")).otherwise(F.col("_here") == 1)).select(*df.columns, *names)


def _hours(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"hour": 1, "day": 24, "week": 168}[unit.lower().rstrip("s")]


def seasonal_profile(df: DataFrame, keys: list[str], season: dict, value: str = "value") -> DataFrame:
    """Mean value per season, where `season` maps names to expressions such as the weekday."""
    parts = [expr.alias(name) for name, expr in season.items()]
    return df.groupBy(*keys, *parts).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def time_bounds(df: DataFrame, ts: str = "ts") -> tuple:
    """First and last time of a frame, two values."""
    row = df.agg(F.min(ts), F.max(ts)).first()
    return row[0], row[1]
