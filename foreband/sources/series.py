"""Time series taken from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreband.operators.timegrid import dealt, hourly_sums


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def raw_load(spark: SparkSession, root: str) -> DataFrame:
    """Load readings: series_id, ts, value."""
    return table(spark, root, "events").select(F.col("event_type").alias("series_id"), "ts", "value")


def hourly_load(spark: SparkSession, root: str, gap: str = "zero") -> DataFrame:
    return hourly_sums(raw_load(spark, root), ["series_id"], gap=gap)


def daily_prices(spark: SparkSession, root: str) -> DataFrame:
    """Daily mean order value per priority: series_id, date, price."""
    return (
        table(spark, root, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("price"))
    )


def daily_volumes(spark: SparkSession, root: str) -> DataFrame:
    """Daily shipped value per supplier, many series in one frame.

    Nearly every row is alone on its day, so combining before the shuffle would hold them all in memory and save nothing.
    """
    lines = table(spark, root, "lineitem")
    rows = lines.select(F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"))
    return dealt(rows, ["series_id", "date"], lines.count()).groupBy("series_id", "date").agg(F.sum("value").alias("value"))
