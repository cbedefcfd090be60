"""Centroid clustering with Walsh-Hadamard progressive search (operator 11).

Vectors and centroids are integers, and so are their Walsh-Hadamard transforms, whose squared differences add up to 64 times the squared
distance. Coefficients are met coarse to fine: the centroid that leads after the coarsest ones is measured in full, and every centroid whose
sum so far exceeds that distance is strictly worse and falls out; those left in the end have all 64 coefficients.
A round is one pass over the vectors; a task gives out one sum per centroid and component, and the centroids' sums alone reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import cut, prepare

DIM = 64
# Components under this keep every sum of squared coefficients within a long.
LARGEST = 1 << 24
# Coefficients known after each step.
STEPS = (2, 6, 16, 32, DIM)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transforms of the rows, as integers."""
    out = x.astype(np.int64)
    h = 1
    while h < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, h)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(out), -1)
        h *= 2
    return out


def coarse_to_fine(dim: int = DIM) -> np.ndarray:
    """Coefficients by rising number of sign changes of their basis vectors."""
    basis = transform(np.eye(dim, dtype=np.int64))
    return np.argsort((np.diff(basis, axis=1) != 0).sum(axis=1), kind="stable")


ORDER = coarse_to_fine()


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and squared distance, for each row."""
    fx, fc = transform(x)[:, ORDER], transform(centroids)[:, ORDER]
    n, k = len(x), len(fc)
    known = np.zeros((n, k), np.int64)
    for c in range(k):
        known[:, c] = ((fx[:, : STEPS[0]] - fc[c, : STEPS[0]]) ** 2).sum(axis=1)
    lead = known.argmin(axis=1)
    bound = ((fx - fc[lead]) ** 2).sum(axis=1)
    open_ = known <= bound[:, None]
    for a, b in zip(STEPS[:-1], STEPS[1:], strict=True):
        for c in range(k):
            rows = np.flatnonzero(open_[:, c])
            known[rows, c] += ((fx[rows, a:b] - fc[c, a:b]) ** 2).sum(axis=1)
            open_[rows, c] = known[rows, c] <= bound[rows]
    known[~open_] = np.iinfo(np.int64).max
    best = known.argmin(axis=1)
    return best, known[np.arange(n), best] // x.shape[1]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), DIM)


def _sums(centroids: np.ndarray):
    """Of one task: the number of vectors (place -1) and the sum of each component, per centroid."""

    def run(batches):
        total = np.zeros((len(centroids), DIM + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                best, _ = nearest(x, centroids)
                for c in range(len(centroids)):
                    mine = x[best == c]
                    total[c] += np.append(len(mine), mine.sum(axis=0))
        cluster, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.ravel()), pa.array(place.ravel() - 1), pa.array(total.ravel())], ["cluster", "place", "s"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                best, distance = nearest(_matrix(b.column("x")), centroids)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, x): floor(scale * component) of the vectors of DIM components, none of them null or non-finite."""
    v = F.col("v_")
    good = (F.size(v) == DIM) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v_")).where(v.isNotNull() & good)
    within = lambda e: F.when(F.abs(e) < LARGEST, e).otherwise(F.raise_error(F.lit(f"component times scale of {LARGEST} or more")))
    return rows.select("id", F.transform(v, lambda e: F.floor(within(e * scale)).cast("long")).alias("x"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per clustered vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly 64 components, none null or non-finite, are clustered as floor(scale * x); others have no row. The k vectors with
    the smallest sha256 of `seed:id` are the first centroids (rows of one id: the smaller vector first; rows without an id are clustered but
    start none); fewer vectors mean fewer centroids, and without one that has an id nothing is clustered. Each round assigns every
    vector to the nearest centroid (ties: smaller number) and replaces each non-empty one by the exact floor of its vectors' mean.
    distance is squared; inertias add it up. Repeated rows count each. A scaled component of 2**24 or more is an error, as sums of squares
    could leave the range of a long. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").orderBy(name, "id", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.x for r in first], np.int64)
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(centroids), "cluster long, place long, s long").groupBy("cluster", "place").agg(F.sum("s").alias("s")).collect()
        total = np.zeros((len(centroids), DIM + 1), np.int64)
        for r in sums:
            total[r.cluster, r.place + 1] = r.s
        full = total[:, 0] > 0
        fresh = centroids.copy()
        fresh[full] = total[full, 1:] // total[full, :1]
        if (fresh == centroids).all():
            break  # later rounds would change nothing
        centroids = fresh
    found = cut(rows.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"))
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
