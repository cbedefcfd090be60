"""Weekly results that are published whole: a rerun of a week replaces it, and readers never see half of one.

Rows of a run lie in a folder of their own, partitioned by model and origin. The run counts only once a row per (model, origin) stands in the
manifest, which one job commits after the data; of several runs of one week the last one counts. One writer publishes at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreband.core import broadcast_if_small, cut, exists, remove

MANIFEST = "model string, origin date, run string, place long, n_rows long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All published (model, origin) with their runs, superseded ones too."""
    at = f"{path}/manifest"
    return spark.read.schema(MANIFEST).parquet(at) if exists(spark, at) else spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The run that counts for each (model, origin)."""
    last = Window.partitionBy("model", "origin").orderBy(F.col("place").desc())
    return manifest(spark, path).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def publish(rows: DataFrame, path: str) -> str:
    """Adds or replaces every (model, origin) of rows; returns the run's name. Without the last step readers see nothing of it."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    place = (manifest(spark, path).agg(F.max("place")).first()[0] or 0) + 1
    rows.write.partitionBy("model", "origin").parquet(f"{path}/data/run={run}")
    written = read_run(spark, path, run, rows.schema).groupBy("model", "origin").agg(F.count(F.lit(1)).alias("n_rows"))
    entry = written.select("model", "origin", F.lit(run).alias("run"), F.lit(place).cast("long").alias("place"), "n_rows")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return run


def read_run(spark: SparkSession, path: str, run: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data/run={run}")


def read_published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that count. Only folders of counting runs are listed; weeks they have lost since are pruned by the join."""
    kept = cut(current(spark, path).select("model", "origin", "run"))
    runs = [r.run for r in kept.select("run").distinct().collect()]
    if not runs:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/run={r}" for r in runs])
    return rows.join(broadcast_if_small(kept), ["model", "origin", "run"], "left_semi").drop("run")


def prune(spark: SparkSession, path: str) -> int:
    """Removes the folders of runs that no longer count for any week; returns how many."""
    every, live = (df.select("run").distinct() for df in (manifest(spark, path), current(spark, path)))
    old = [r.run for r in every.join(live, "run", "left_anti").collect()]
    for run in old:
        remove(spark, f"{path}/data/run={run}")
    return len(old)
