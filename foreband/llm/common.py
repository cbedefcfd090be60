"""What the text operators share: session limits, lineage cuts, links to groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreband.core import cut, release, ship, unsized

__all__ = ["ID_LIMIT", "cut", "free", "gathered", "grouped", "joined_hot", "prepare", "release", "table", "unsized"]

# Ids (16 bytes each) are broadcast only after a count has shown at most this many; beyond, they are joined by shuffle.
ID_LIMIT = 500_000


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds the batches that go to Python by rows and by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def gathered(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """df in no more partitions than `each` rows a task need, so that a small frame doesn't leave a file for every shuffle partition."""
    return df.coalesce(max(1, math.ceil(rows / each)))


def free(name: str, columns: list[str]) -> str:
    """The name, lengthened until none of the columns has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def grouped(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links: one row (id, component) per linked id; component is the smallest id reached.

    First each id takes its smallest neighbour's smallest neighbour, and links are drawn between those, so that of a large group of many
    links little is left. Then labels go to neighbours and are replaced by their own label (pointer jumping), so that chains halve each round.
    Every label move is a combining aggregate; nothing but a count of changes reaches the driver.
    """
    rows = 2 * links.count()
    # A label takes 16 bytes; there are at most as many as link ends.
    hint = F.broadcast if rows <= ID_LIMIT else (lambda df: df)
    ends = [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]
    pairs = cut(gathered(gathered(links.where(F.col(a) != F.col(b)).select(*ends), rows).distinct(), rows))
    labels = _smallest(pairs, rows)
    near = hint(labels.select(F.col("id").alias("component"), F.col("component").alias("c")))
    labels = cut(gathered(labels.join(near, "component").select("id", F.col("c").alias("component")), rows))
    for column in ("low", "high"):
        pairs = pairs.join(hint(labels.select(F.col("id").alias(column), F.col("component").alias(f"{column}_c"))), column)
    pairs = pairs.where("low_c != high_c").select(F.least("low_c", "high_c").alias("low"), F.greatest("low_c", "high_c").alias("high"))
    pairs = cut(gathered(gathered(pairs, rows).distinct(), rows))
    left = 2 * pairs.count()
    if not left:
        return unsized(labels)
    known = _spread(pairs, left).select(F.col("id").alias("component"), F.col("component").alias("c"))
    known = F.broadcast(known) if left <= ID_LIMIT else known
    return unsized(cut(gathered(labels.join(known, "component", "left").select("id", F.coalesce("c", "component").alias("component")), rows)))


def _smallest(pairs: DataFrame, rows: int) -> DataFrame:
    """The smallest of each id and its neighbours: rows (id, component)."""
    both = pairs.select(F.col("low").alias("id"), F.col("high").alias("m")).union(pairs.select("high", "low"))
    return cut(gathered(both.groupBy("id").agg(F.min("m").alias("m")).select("id", F.least("id", "m").alias("component")), rows))


def _spread(pairs: DataFrame, rows: int) -> DataFrame:
    """Components of distinct pairs (low, high), by labels that go to neighbours; rows: number of their ends."""
    hint = F.broadcast if rows <= ID_LIMIT else (lambda df: df)
    both = cut(gathered(pairs.select(F.col("low").alias("id"), F.col("high").alias("to")).union(pairs.select("high", "low")), rows))
    labels = _smallest(pairs, rows)
    while True:
        near = (
            both.join(hint(labels.select(F.col("id").alias("to"), F.col("component").alias("m"))), "to").groupBy("id").agg(F.min("m").alias("m"))
        )
        moved = near.join(hint(labels), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        jumped = moved.join(hint(labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))), "mid")
        jumped = unsized(cut(gathered(jumped.select("id", "old", F.least("mid", "far").alias("component")), rows)))
        changed = jumped.where("old != component").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels


def joined_hot(rows: DataFrame, info: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with info, which has one row per key; info[size]: how many of the `total` rows hold the key.

    A key of more than a thousandth of the rows, so one of under a thousand keys, reaches its rows by broadcast; the others by shuffle.
    """
    hot = F.broadcast(info.where(F.col(size) * 1000 > total))
    rest = info.where(F.col(size) * 1000 <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, "left"))
