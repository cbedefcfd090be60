"""The registered queries opN_<name> over the given tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foreband.llm import alignment, centroids, extraction, jaccard_join, minhash, mixing, near_vectors, packing, quality, secrets, token_counts, topk, toxicity
from foreband.core import checkpoint_dir
from foreband.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@query("op1_mix_sources")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op2_secret_scan")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return secrets.scan(table(spark, root, "documents"))


@query("op3_minhash_fingerprints")
def op3(spark: SparkSession, root: str) -> DataFrame:
    return minhash.fingerprints(table(spark, root, "documents"))


@query("op4_main_text")
def op4(spark: SparkSession, root: str) -> DataFrame:
    return extraction.main_text(table(spark, root, "pages"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


@query("op6_token_counts")
def op6(spark: SparkSession, root: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every run counts the tables it is given."""
    cache = f"{checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, root, "documents"), cache)


SQL["op7_exact_top_k"] = """
WITH parts AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings WHERE vec_id IS NOT NULL),
good AS (SELECT vec_id FROM parts GROUP BY vec_id HAVING count(*) = count(x) AND bool_and(isfinite(CAST(x AS DOUBLE)))),
v AS (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS e FROM parts WHERE vec_id IN (SELECT vec_id FROM good)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.e * c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.i = c.i AND q.vec_id != c.vec_id
      WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10"""


@query("op7_exact_top_k")
def op7(spark: SparkSession, root: str) -> DataFrame:
    return topk.top_k(table(spark, root, "embeddings"))


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.components(table(spark, root, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op9_toxicity_chain")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.classify(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return quality.classify(table(spark, root, "documents"), table(spark, root, "labels"))


def _cluster_sql(rounds: int) -> str:
    """The clustering in plain SQL: one pair of tables per round."""
    apart = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        """good AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, e) - 1 AS k, e FROM good WHERE vec_id IS NOT NULL QUALIFY k < 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT v.n, min(struct_pack(d := CAST({apart} AS BIGINT), k := c.k)) AS b FROM good v, c{i} c GROUP BY v.n)")
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.e, o.e) AS e FROM c{i} o LEFT JOIN (
                    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
                        SELECT b.k AS k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                        FROM d{i} JOIN (SELECT n, unnest(e) AS x, unnest(range(64)) AS i FROM good) USING (n) GROUP BY 1, 2) GROUP BY k) m USING (k))"""
            )
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
            CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM d{rounds} JOIN good USING (n) JOIN c{rounds} c ON c.k = b.k"""


SQL["op11_walsh_centroids"] = _cluster_sql(10)


@query("op11_walsh_centroids")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return centroids.cluster(table(spark, root, "embeddings"))


@query("op12_token_alignment")
def op12(spark: SparkSession, root: str) -> DataFrame:
    return alignment.align(table(spark, root, "documents"))


SQL["op13_near_vectors"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT n, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)),
links AS MATERIALIZED (SELECT a.n, b.n AS m FROM good a JOIN good b ON a.label = b.label AND a.n != b.n AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
    WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT n, n AS m FROM v UNION SELECT r.n, l.m FROM reach r JOIN links l ON l.n = r.m),
low AS (SELECT r.n, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.n = r.m GROUP BY r.n)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.n = v.n) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN low USING (n)"""


@query("op13_near_vectors")
def op13(spark: SparkSession, root: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, root, "embeddings"))
