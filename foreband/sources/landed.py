"""Readers for landed files: German-number CSV, JSON chunks, calendars, weekly result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreband.functions.dates import epoch_ms_to_local, parse_day_and_hour
from foreband.functions.numbers import parse_decimal_comma

FORECAST_SCHEMA = "model string, series_id string, origin date, ts timestamp_ntz, horizon int, tau double, y double, q double"


def read_decimal_comma_load(spark: SparkSession, path: str, columns: int = 4, series_id: str = "load") -> DataFrame:
    """Hourly load from `;` files with dotted dates and decimal commas; the value is in thousands.

    Only the first four columns count: day, start of the hour, end, value. Rows without a number are dropped.
    `columns` is the number of columns in the files; all are read as text.
    """
    names = ["day", "start", "end", "amount", *[f"_c{i}" for i in range(4, columns)]]
    text = spark.read.csv(path, sep=";", header=True, schema=", ".join(f"{n} string" for n in names), enforceSchema=True)
    return text.select(
        F.lit(series_id).alias("series_id"),
        parse_day_and_hour(F.col("day"), F.col("start")).alias("ts"),
        (parse_decimal_comma(F.col("amount")) / 1000).alias("value"),
    ).filter("value IS NOT NULL")


def read_json_chunks(spark: SparkSession, path: str, zone: str, skip_chunks: int = 0, series_id: str = "load") -> DataFrame:
    """Readings from chunk files `{"series": [[epoch_ms, value or null], ...]}`, one document per chunk.

    The oldest `skip_chunks` chunks are left out; a chunk is as old as its first time. Keeps the UTC
    milliseconds next to the local time, whose autumn hour is ambiguous.
    """
    docs = spark.read.json(path, schema="series array<array<double>>", multiLine=True)
    if skip_chunks:
        # A distributed top-n over one number per file.
        chunk = F.element_at(F.element_at("series", 1), 1)
        oldest = docs.select(chunk.alias("_start")).distinct().orderBy("_start").limit(skip_chunks)
        cutoff = oldest.agg(F.max("_start")).first()[0]
        if cutoff is not None:
            docs = docs.filter(chunk > F.lit(cutoff))
    pairs = docs.select(F.explode("series").alias("p"))
    return pairs.select(
        F.lit(series_id).alias("series_id"),
        F.element_at("p", 1).cast("long").alias("epoch_ms"),
        epoch_ms_to_local(F.element_at("p", 1), zone).alias("ts"),
        F.element_at("p", 2).alias("value"),
    ).filter("value IS NOT NULL")


def read_prices(spark: SparkSession, path: str, symbol: str, first, last, fmt: str = "parquet") -> DataFrame:
    """Daily prices of one symbol within [first, last]; rows without a price are dropped."""
    reader = spark.read.schema("symbol string, date date, adjusted double").option("header", True)
    rows = reader.format(fmt).load(path).filter((F.col("symbol") == symbol) & F.col("date").between(F.lit(first), F.lit(last)))
    return rows.select(F.col("symbol").alias("series_id"), "date", F.col("adjusted").alias("price")).dropna(subset=["price"])


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="x date").select(F.col("x").alias("date"))


def read_daylight(spark: SparkSession, path: str) -> DataFrame:
    """Daylight per day from a CSV whose first column has no name."""
    return spark.read.csv(path, header=True, schema="date date, daylight double", enforceSchema=True)


def read_actuals(spark: SparkSession, path: str, times: DataFrame) -> DataFrame:
    """Observed values at the wanted times."""
    rows = spark.read.csv(path, header=True, schema="date_time string, value double")
    rows = rows.select(F.col("date_time").cast("timestamp_ntz").alias("ts"), "value").withColumn("date", F.to_date("ts"))
    return rows.join(times.select("ts"), "ts", "left_semi")


def read_weekly(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All weekly CSV files of a glob in one read, with the week taken from the name of the file (`..._week3.csv`) or of its folder (`week=3`)."""
    rows = spark.read.csv(pattern, header=True, schema=schema)
    week = F.regexp_extract(F.col("_metadata.file_path"), r"week=?(\d+)(?:\.csv$|/)", 1).cast("int")
    return rows.withColumn("week", week)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORECAST_SCHEMA).parquet(path)
