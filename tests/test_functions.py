import datetime as dt

import pytest
from pyspark.sql import functions as F

from foreband.functions import calendar as C
from foreband.functions import dates as D
from foreband.functions.numbers import format_decimal_comma, level_name, parse_decimal_comma, row_mean, row_sum
from foreband.functions.scores import negated_pinball2, pinball, pinball2


def one(df):
    return df.first()[0]


def test_decimal_comma(spark):
    df = spark.createDataFrame([("1.234,56",), ("-7,5",), ("n/a",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_decimal_comma(F.col("t"))).collect()]
    assert got == [1234.56, -7.5, None, None]
    assert one(spark.range(1).select(format_decimal_comma(F.lit(1234.56)))) == "1.234,56"


def test_parse_day_and_hour(spark):
    df = spark.createDataFrame([("15.11.2023", "23:00"), ("bad", "23:00")], "d string, h string")
    got = [r[0] for r in df.select(D.parse_day_and_hour(F.col("d"), F.col("h"))).collect()]
    assert got == [dt.datetime(2023, 11, 15, 23), None]


def test_epoch_to_local_follows_daylight_saving(spark):
    ms = [1700000000000, 1690000000000]
    df = spark.createDataFrame([(m,) for m in ms], "ms long")
    got = [r[0] for r in df.select(D.epoch_ms_to_local(F.col("ms"), "Europe/Berlin")).collect()]
    assert got == [dt.datetime(2023, 11, 14, 23, 13, 20), dt.datetime(2023, 7, 22, 6, 26, 40)]


def test_horizons_of_target_hours(spark):
    origin = dt.date(2023, 11, 15)
    hours = [(origin, dt.datetime(2023, 11, 16 + d, h)) for d in range(3) for h in range(24)]
    df = spark.createDataFrame(hours, "o date, ts timestamp_ntz").filter(D.in_target_hours(F.col("ts")))
    got = [r[0] for r in df.select(D.horizon_hours(F.col("o"), F.col("ts")).alias("h")).orderBy("h").collect()]
    assert got == [36, 40, 44, 60, 64, 68]
    days = spark.createDataFrame([(origin, dt.date(2023, 11, 20))], "o date, d date")
    label = D.horizon_label(D.horizon_days(F.col("o"), F.col("d")), "day")
    assert one(days.select(label)) == "5 day"


def test_holiday_counts_and_easter(spark):
    assert C.holidays(spark, 2018, 2024).count() == 98
    assert C.holidays(spark, 2015, 2024).distinct().count() == 140
    years = spark.createDataFrame([(2019,), (2023,), (2024,)], "year int")
    got = {r["year"]: r["easter"] for r in C.with_easter(years).collect()}
    assert got == {2019: dt.date(2019, 4, 21), 2023: dt.date(2023, 4, 9), 2024: dt.date(2024, 3, 31)}


def test_business_days_leave_out_holidays(spark):
    df = spark.createDataFrame([("s", dt.date(2023, 12, 20))], "k string, origin date")
    days = C.business_days_after(df, ["k"], "origin", C.holidays(spark, 2023, 2024))
    got = [(r["step"], r["date"]) for r in days.orderBy("step").collect()]
    assert got == [(1, dt.date(2023, 12, 21)), (2, dt.date(2023, 12, 22)), (3, dt.date(2023, 12, 27))]
    assert C.business_days_after(df, ["k"], "origin", None).count() == 5


def test_daylight_is_longest_in_june(spark):
    days = spark.createDataFrame([(dt.date(2023, 6, 21),), (dt.date(2023, 12, 21),), (dt.date(2023, 3, 20),)], "d date")
    june, december, march = [r[0] for r in days.select(C.daylight_hours(F.col("d"))).collect()]
    assert june == pytest.approx(16.5, abs=0.2)
    assert december == pytest.approx(7.9, abs=0.2)
    assert march == pytest.approx(12.2, abs=0.2)
    # beyond the polar circle
    assert one(days.limit(1).select(C.daylight_hours(F.col("d"), F.lit(75.0)))) == 24.0


def test_pinball_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 3.0), (10.0, 14.0)], "y double, q double")
    neg = negated_pinball2(F.col("y"), F.col("q"), F.lit(0.25))
    assert one(df.select(F.avg(neg))) == pytest.approx(-8 / 3)
    assert one(df.select(negated_pinball2(F.col("y"), F.col("q"), F.lit(1.5)))) is None
    # An observed return, its .025 quantile forecast and the score that goes with them.
    pair = spark.createDataFrame([(0.243797155991388, -2.24581633569991)], "y double, q double")
    args = F.col("y"), F.col("q"), F.lit(0.025)
    assert one(pair.select(pinball2(*args))) == pytest.approx(0.124480674584565, abs=1e-12)
    assert one(pair.select(pinball(*args))) == pytest.approx(0.124480674584565 / 2, abs=1e-12)


def test_row_sums_and_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0)], "a double, b double, c double")
    assert df.select(row_sum(*df), row_mean(*df)).first()[:] == (9.0, 3.0)
    assert level_name("q", 0.025) == "q0_025"
