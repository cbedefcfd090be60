"""From raw documents to packed training sequences, in five stages; each takes what the one before kept.

quality: documents that the classifier rejects go. dedupe: of each group of linked documents the one with the smallest id stays.
secrets: secrets are masked, every document stays. mix: documents are dropped or repeated so that sources meet their shares. pack: token
sequences. All stages but the last return the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreband.core import checkpoint_dir
from foreband.llm import jaccard_join, mixing, packing, quality, secrets
from foreband.llm.common import ID_LIMIT, cut, table

# Documents below this score are rejected.
LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score LEAST_QUALITY or more; the classifier learns from the labels of the folder's documents."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="quality_score_").where(F.col("quality_score_") >= LEAST_QUALITY).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: five-word shingles, Jaccard 0.8 or more, as op3 verifies near duplicates; op8's own four
    words and 0.85 hold for its query only. Texts without words, which link with nothing, and rows without an id all stay; of rows alike in
    id and text one stays."""
    found = cut(jaccard_join.components(docs, size=5, num=80, den=100))
    kept = cut(found.where("doc_id is not null and (n_shingles = 0 or doc_id = component_id)").select(F.col("doc_id").alias("kept_id")).distinct())
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    # Ids are broadcast only if a count has shown them to be few.
    few = F.broadcast(kept) if kept.count() <= ID_LIMIT else kept
    out = docs.where("doc_id is not null").join(few, docs["doc_id"] == F.col("kept_id"), "left_semi")
    if repeated:
        alike = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
        out = out.withColumn("nth_", F.row_number().over(alike)).where("nth_ = 1").select(*docs.columns)
    return out.unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("dedupe", drop_near_copies), ("secrets", mask_secrets), ("mix", mix_sources), ("pack", pack_sequences)]

# A fitted classifier decides what goes into all later stages, which SQL can't restate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
