"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col):
    """Rows that no label is learned from: CRC-32 of the id as text divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most `most` labelled documents, the first by a hash of the id, none of them held out."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .where(~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("id", "text", "label")
