"""Public holidays, business days and daylight as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreband.core import broadcast_if_small

# The holiday rule, days after Easter Sunday and (month, day) pairs.
EASTER_OFFSETS = (-2, 1, 39, 50, 60)
FIXED_HOLIDAYS = ((1, 1), (1, 6), (5, 1), (10, 3), (10, 31), (11, 1), (12, 24), (12, 25), (12, 26))

GERMANY_LATITUDE = 51.1657
SUN_ALTITUDE_DEG = -0.833


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def with_easter(df: DataFrame, year: str = "year") -> DataFrame:
    """Adds `easter`, Easter Sunday by the Gregorian computus. Each step is a column, used more than once below it."""
    y, c = F.col(year), F.col
    steps = [
        {"_golden": y % 19, "_century": _div(y, 100), "_rest": y % 100},
        {"_moon": _div(c("_century") - _div(c("_century") + 8, 25) + 1, 3)},
        {"_epact": (c("_golden") * 19 + c("_century") - _div(c("_century"), 4) - c("_moon") + 15) % 30},
        {"_sunday": ((c("_century") % 4) * 2 + _div(c("_rest"), 4) * 2 - c("_epact") - c("_rest") % 4 + 32) % 7},
        {"_shift": _div(c("_golden") + c("_epact") * 11 + c("_sunday") * 22, 451)},
        {"_n": c("_epact") + c("_sunday") - c("_shift") * 7 + 114},
        {"easter": F.make_date(y, _div(c("_n"), 31), c("_n") % 31 + 1)},
    ]
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.select(*df.columns, "easter")


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per public holiday, column `date`; 14 rows per year."""
    years = spark.range(first_year, last_year + 1, numPartitions=1).select(F.col("id").cast("int").alias("year"))
    days = [F.date_add("easter", k) for k in EASTER_OFFSETS]
    days += [F.make_date("year", F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    return with_easter(years).select(F.explode(F.array(*days)).alias("date"))


def business_days_after(df: DataFrame, keys: list[str], origin: str, holidays: DataFrame | None, span: int = 7) -> DataFrame:
    """One row per working day within `span` days after the origin, with its `step` from 1.

    Without a holiday table every Monday to Friday counts.
    """
    days = F.sequence(F.date_add(origin, 1), F.date_add(origin, span))
    rows = df.select(*keys, origin, F.explode(F.filter(days, lambda d: F.weekday(d) < 5)).alias("date"))
    if holidays is not None:
        rows = rows.join(broadcast_if_small(holidays), "date", "left_anti")
    w = Window.partitionBy(*keys, origin).orderBy("date")
    return rows.withColumn("step", F.row_number().over(w))


def daylight_hours(day: Column, latitude: Column | float = GERMANY_LATITUDE) -> Column:
    """Hours between sunrise and sunset from the solar declination (Spencer's series)."""
    lat = F.radians(latitude if isinstance(latitude, Column) else F.lit(float(latitude)))
    g = (F.dayofyear(day) - 1) * F.lit(2 * math.pi / 365)
    decl = (
        F.lit(0.006918)
        - F.cos(g) * 0.399912
        + F.sin(g) * 0.070257
        - F.cos(g * 2) * 0.006758
        + F.sin(g * 2) * 0.000907
        - F.cos(g * 3) * 0.002697
        + F.sin(g * 3) * 0.00148
    )
    altitude = F.lit(math.sin(math.radians(SUN_ALTITUDE_DEG)))
    cos_hour = (altitude - F.sin(lat) * F.sin(decl)) / (F.cos(lat) * F.cos(decl))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_hour))
    return F.acos(clipped) * F.lit(24 / math.pi)


def trading_days(spark: SparkSession, first, last, closed: DataFrame | None = None) -> DataFrame:
    """The trading calendar of [first, last] as one row with the array `days`: Mondays to Fridays without the dates of `closed`."""
    days = F.filter(F.sequence(F.lit(first), F.lit(last)), lambda d: F.weekday(d) < 5)
    calendar = spark.range(1).select(days.alias("days"))
    if closed is not None:
        shut = closed.filter(F.col("date").between(F.lit(first), F.lit(last))).agg(F.collect_set("date").alias("_c"))
        calendar = calendar.crossJoin(shut).select(F.array_except("days", "_c").alias("days"))
    return calendar


def trading_targets(calendar: DataFrame, origins: list, steps: int) -> DataFrame:
    """The next trading days after each origin by their position in the calendar: origin, step (from 1), date, horizon (calendar days)."""
    seen = F.size(F.filter("days", lambda d: d <= F.col("origin")))
    each = calendar.select("days", F.explode(F.array(*[F.lit(o) for o in origins])).alias("origin"))
    ahead = each.select("origin", F.posexplode(F.slice("days", seen + 1, F.lit(steps))).alias("_i", "date"))
    return ahead.select("origin", (F.col("_i") + 1).alias("step"), "date", F.datediff("date", "origin").alias("horizon"))


def on_trading_days(df: DataFrame, calendar: DataFrame, day: str = "date") -> DataFrame:
    """Rows whose day is in the calendar."""
    return df.join(broadcast_if_small(calendar.select(F.explode("days").alias(day))), day, "left_semi")
