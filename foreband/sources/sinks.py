"""Writers; forecasts and scores are partitioned by model and origin so that readers prune whole folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.functions.dates import utc_to_epoch_ms
from foreband.functions.numbers import format_decimal_comma


def write_forecasts(forecasts: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Forecasts, with or without actuals."""
    forecasts.write.mode(mode).partitionBy("model", "origin").format(fmt).save(path)


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    scores.write.mode(mode).partitionBy("model", "origin").format(fmt).save(path)


def write_parameters(params: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Model coefficients, chosen orders or cross-validation results."""
    params.write.mode(mode).parquet(path)


def write_holidays(holidays: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One sorted CSV column named x."""
    holidays.select(holidays["date"].alias("x")).orderBy("x").coalesce(1).write.mode(mode).csv(path, header=True)


def write_weekly(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV in a folder `week=<n>` per week, all weeks in one job."""
    rows.repartition("week").write.mode(mode).partitionBy("week").csv(path, header=True)


def write_decimal_comma_load(load: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Readings as `;` files with dotted days, hours and decimal commas."""
    text = load.select(
        F.date_format("ts", "dd.MM.yyyy").alias("Datum"),
        F.date_format("ts", "HH:mm").alias("Anfang"),
        F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "HH:mm").alias("Ende"),
        format_decimal_comma(F.col("value")).alias("Gesamt"),
    )
    text.write.mode(mode).csv(path, sep=";", header=True)


def write_json_chunks(load: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per week of readings: `{"series": [[epoch_ms, value], ...]}`."""
    pair = F.array(utc_to_epoch_ms(F.col("ts")).cast("double"), F.col("value"))
    chunks = load.groupBy(F.date_trunc("week", "ts").alias("_w")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(pair)).alias("series"))).alias("value"))
    chunks.select("value").write.mode(mode).option("maxRecordsPerFile", 1).text(path)
