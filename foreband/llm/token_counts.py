"""Token counts through a digest cache (operator 6).

The cache is a table of (tokenizer, content, n_tokens): digests of a tokenizer's version and of a normalised content. Documents are digested,
digests that the cache lacks are found by a join, one document of each is encoded, and the new counts are appended.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import ID_LIMIT, cut, prepare
from foreband.llm.tokens import default_path, encoder

CACHE = "tokenizer string, content binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's file content and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + f.read()).hexdigest()


def _counts(path: str):
    def run(batches):
        encode = encoder(path).encode
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(encode(texts, want_ids=False), pa.int64())], ["content", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, cache: str, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", normalise=None
) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    cache: folder of the count table, in storage that all executors share; made if absent. normalise: column function applied to
    texts before digest and count; by default none, as counts are of the exact text. A null text is empty, with no token. Special
    strings in a text are handled as by the library's default. Repeated rows are counted once and returned each.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or default_path()
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    narrow = cut(rows.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")))

    def stored() -> DataFrame:
        try:
            known = spark.read.schema(CACHE).parquet(cache)
        except AnalysisException:
            known = spark.createDataFrame([], CACHE)
        return known.where(F.col("tokenizer") == version).select("content", "n_tokens")

    missing = cut(narrow.groupBy("content").agg(F.min("id").alias("id")).join(stored(), "content", "left_anti"))
    n = missing.count()
    if n:
        # Few ids go to the documents; more than the limit are joined by shuffle.
        wanted = missing.select(F.col("id").alias("wanted_id"), F.col("content").alias("wanted"))
        wanted = F.broadcast(wanted) if n <= ID_LIMIT else wanted
        first = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("content") == F.col("wanted")), "left_semi")
        fresh = first.select("content", "text").mapInArrow(_counts(path), "content binary, n_tokens long")
        fresh = fresh.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # rows alike in id and text are found together
        fresh.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    # Appends of several runs may hold one content twice, with one count.
    known = stored().groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    joined = narrow.join(known, "content")
    return joined.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
