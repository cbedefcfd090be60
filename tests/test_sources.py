import datetime as dt
import json

from pyspark.sql import functions as F

from foreband.functions.calendar import holidays
from foreband.sources import landed, published, sinks


def test_decimal_comma_file(spark, tmp_path):
    lines = ["Datum;Anfang;Ende;Gesamt [MWh];Rest", "01.01.2019;00:00;01:00;42.123,25;1", "01.01.2019;01:00;02:00;-;1"]
    (tmp_path / "load.csv").write_text("\n".join(lines) + "\n")
    got = landed.read_decimal_comma_load(spark, str(tmp_path / "load.csv"), columns=5).collect()
    assert [(r["ts"], r["value"]) for r in got] == [(dt.datetime(2019, 1, 1), 42.12325)]


def test_json_chunks(spark, tmp_path):
    start = 1700000000000
    for i in range(3):
        series = [[start + i * 10**7 + k * 900000, None if k == 1 else float(10 * i + k)] for k in range(3)]
        (tmp_path / f"chunk{i}.json").write_text(json.dumps({"series": series}))
    rows = landed.read_json_chunks(spark, str(tmp_path), "Europe/Berlin", skip_chunks=1)
    assert sorted(r["value"] for r in rows.collect()) == [10.0, 12.0, 20.0, 22.0]
    first = landed.read_json_chunks(spark, str(tmp_path), "Europe/Berlin").orderBy("epoch_ms").first()
    assert first["ts"] == dt.datetime(2023, 11, 14, 23, 13, 20)


def test_prices_and_calendars(spark, tmp_path):
    px = [("^X", dt.date(2020, 1, d), None if d == 2 else float(d)) for d in range(1, 6)] + [("^Y", dt.date(2020, 1, 1), 1.0)]
    spark.createDataFrame(px, "symbol string, date date, adjusted double").write.parquet(str(tmp_path / "px"))
    got = landed.read_prices(spark, str(tmp_path / "px"), "^X", dt.date(2020, 1, 1), dt.date(2020, 1, 4))
    assert sorted(r["price"] for r in got.collect()) == [1.0, 3.0, 4.0]
    sinks.write_holidays(holidays(spark, 2020, 2021), str(tmp_path / "hol"))
    assert landed.read_holidays(spark, str(tmp_path / "hol")).count() == 28
    (tmp_path / "light.csv").write_text(",daylight\n2020-01-01,7.9\n")
    assert landed.read_daylight(spark, str(tmp_path / "light.csv")).first()[:] == (dt.date(2020, 1, 1), 7.9)


def test_weekly_files_and_actuals(spark, tmp_path):
    for w in (1, 2, 12):
        (tmp_path / f"scores_week{w}.csv").write_text(f"forecast_date,mean_qs\n2023-11-15,{w}.5\n")
    got = landed.read_weekly(spark, str(tmp_path / "scores_week*.csv"), "forecast_date date, mean_qs double")
    assert sorted((r["week"], r["mean_qs"]) for r in got.collect()) == [(1, 1.5), (2, 2.5), (12, 12.5)]
    (tmp_path / "y.csv").write_text("date_time,value\n2023-11-17 12:00:00,55.5\n2023-11-17 13:00:00,56.5\n")
    times = spark.createDataFrame([(dt.datetime(2023, 11, 17, 12),)], "ts timestamp_ntz")
    assert landed.read_actuals(spark, str(tmp_path / "y.csv"), times).select("value").first()[0] == 55.5


def test_forecasts_survive_writing(spark, tmp_path):
    rows = [("m", "s", dt.date(2024, 1, 10 + i), dt.datetime(2024, 1, 12), 12, 0.5, 1.0, 2.0) for i in range(2)]
    df = spark.createDataFrame(rows, landed.FORECAST_SCHEMA)
    sinks.write_forecasts(df, str(tmp_path / "fc"))
    back = landed.read_forecasts(spark, str(tmp_path / "fc"))
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())
    assert back.filter(F.col("origin") == dt.date(2024, 1, 10)).count() == 1


def test_published_weeks_replace_each_other_and_hide_unfinished_runs(spark, tmp_path):
    schema = "model string, origin date, q double"
    path, days = str(tmp_path / "p"), [dt.date(2024, 1, 3), dt.date(2024, 1, 10)]
    assert published.read_published(spark, path, schema).collect() == []
    published.publish(spark.createDataFrame([("m", d, 1.0) for d in days] + [("n", days[0], 5.0)], schema), path)
    published.publish(spark.createDataFrame([("m", days[1], 2.0)], schema), path)
    rows = lambda: sorted((r.model, r.origin, r.q) for r in published.read_published(spark, path, schema).collect())
    want = [("m", days[0], 1.0), ("m", days[1], 2.0), ("n", days[0], 5.0)]
    assert rows() == want and published.prune(spark, path) == 0
    # A run whose data are there but whose manifest row isn't.
    spark.createDataFrame([("m", days[0], 9.0)], schema).write.partitionBy("model", "origin").parquet(f"{path}/data/run=lost")
    assert rows() == want
    published.publish(spark.createDataFrame([("m", d, 3.0) for d in days] + [("n", days[0], 3.0)], schema), path)
    assert {q for _, _, q in rows()} == {3.0} and published.prune(spark, path) == 2 and len(rows()) == 3


def test_weekly_files_by_name_and_by_folder(spark, tmp_path):
    (tmp_path / "r_week12.csv").write_text("a,b\n1,x\n")
    (tmp_path / "week=3").mkdir()
    (tmp_path / "week=3" / "part-0.csv").write_text("a,b\n2,y\n")
    read = lambda p: [tuple(r) for r in landed.read_weekly(spark, str(tmp_path / p), "a int, b string").select("week", "a").collect()]
    assert read("r_week*.csv") == [(12, 1)] and read("week=*") == [(3, 2)]
