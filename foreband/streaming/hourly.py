"""The hourly grid over a folder in which chunk files keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreband.functions.dates import epoch_ms_to_local


def arriving_chunks(spark: SparkSession, path: str, zone: str, series_id: str = "load", files_per_trigger: int = 100) -> DataFrame:
    """Readings of new chunk files: series_id, at (instant), ts (wall clock), value."""
    docs = (
        spark.readStream.schema("series array<array<double>>")
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    pairs = docs.select(F.explode("series").alias("p")).filter(F.element_at("p", 2).isNotNull())
    ms = F.element_at("p", 1)
    return pairs.select(
        F.lit(series_id).alias("series_id"),
        F.timestamp_millis(ms.cast("long")).alias("at"),
        epoch_ms_to_local(ms, zone).alias("ts"),
        F.element_at("p", 2).alias("value"),
    )


def hourly_stream(readings: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Hourly sums by instant; an hour is final once readings `lateness` younger than it have come."""
    return (
        readings.withWatermark("at", lateness)
        .groupBy("series_id", F.window("at", "1 hour").alias("_w"))
        .agg(F.sum("value").alias("value"))
        .select("series_id", F.col("_w.start").alias("at"), "value")
    )
