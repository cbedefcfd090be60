"""Date and time expressions; weekdays count from Monday = 0 everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)


def parse_day_and_hour(day: Column, hour: Column) -> Column:
    """`31.12.2023` and `23:00` to a timestamp without zone; bad text becomes null."""
    # Day and hour are parsed apart: together they might not exist in the session's zone.
    date = F.try_to_timestamp(day, F.lit("dd.MM.yyyy")).cast("date")
    clock = F.try_to_timestamp(F.concat(F.lit("01.01.2000 "), hour), F.lit("dd.MM.yyyy HH:mm"))
    return wall_clock(F.unix_date(date).cast("long") * 86400 + F.hour(clock) * 3600 + F.minute(clock) * 60)


def wall_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def wall_clock(seconds: Column) -> Column:
    """Inverse of `wall_seconds`."""
    day = F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int")).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(seconds, F.lit(86400)))


def epoch_ms_to_local(ms: Column, zone: str) -> Column:
    """Epoch milliseconds to the wall clock of `zone`; parts of a second are dropped."""
    utc = wall_clock(F.floor(ms / F.lit(1000)).cast("long"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def utc_to_epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a UTC wall clock."""
    return wall_seconds(ts) * 1000


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.weekday(day) + 1)


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), F.month(day))


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Calendar features of a timestamp or date column."""
    t = F.col(ts)
    return df.withColumns(
        {
            "hour": F.hour(t),
            "dayofweek": F.weekday(t),
            "quarter": F.quarter(t),
            "month": F.month(t),
            "year": F.year(t),
            "dayofyear": F.dayofyear(t),
            "dayofmonth": F.dayofmonth(t),
            "weekofyear": F.weekofyear(t),
            "date": F.to_date(t),
        }
    )


def horizon_hours(origin: Column, ts: Column) -> Column:
    """Hours from the end of the origin day to `ts`."""
    days = F.datediff(F.to_date(ts), origin) - 1
    return (days * 24 + F.hour(ts)).cast("int")


def horizon_days(origin: Column, day: Column) -> Column:
    return F.datediff(day, origin)


def horizon_label(n: Column, unit: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.lit(unit))


def compact_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def parse_compact_date(text: Column) -> Column:
    return F.to_date(text, "yyyyMMdd")


def in_target_hours(ts: Column, weekdays=(4, 5), hours=(12, 16, 20)) -> Column:
    return F.weekday(ts).isin(*weekdays) & F.hour(ts).isin(*hours)
