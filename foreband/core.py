"""Session-level helpers: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame is broadcast only after a count has shown it stays below this many rows.
BROADCAST_ROWS = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the one the cluster names, or a temporary one in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foreband-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """df with Spark's default estimate of its size. A checkpoint keeps the estimate of its plan, a product for each join, so that a loop which
    joins its own checkpoints soon has estimates of millions of digits, which the driver multiplies and holds."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def release(spark: SparkSession) -> None:
    """Collects garbage in Python and in the driver's JVM, so that Spark's cleaner drops broadcasts, shuffle files and checkpoints of frames
    that are out of use, and the JVM gives back heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever storage it names."""
    fs, at = _file_system(spark, path)
    return bool(fs.exists(at))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A new folder in the shared one, removed in the end."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="foreband-package-")
    archive = shutil.make_archive(os.path.join(folder, "foreband"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; a bigger frame is left to a shuffle join."""
    return F.broadcast(df) if is_small(df, rows) else df


def parallelism(spark: SparkSession) -> int:
    """Number of tasks to spread block work over: every core, and on a cluster no fewer than the shuffle setting."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        return sc.defaultParallelism
    return max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
