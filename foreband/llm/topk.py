"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists (operator 7).

Candidates are dealt into blocks by id, queries into blocks of their own; each candidate block sorts its lists once and serves every block of
queries. A query reads its lists from the best end, all dimensions in step, scores whatever it meets, and stops once no unread candidate
can reach its kth score. The k best of each block then meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreband.llm.common import cut, prepare

CANDIDATES, QUERIES, STEP = 8_192, 256, 64
# Sums of products below this are exact as doubles.
EXACT = 1 << 53
# Components below this give scores of up to 2,048 dimensions within a long.
LARGEST = 2.0**26


def _whole(scale: float):
    def run(batches):
        for b in batches:
            ids, dims, raw = [], [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("vector"), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy().astype(float)
                if np.isfinite(x).all():
                    if len(x) and np.abs(scale * x).max() >= LARGEST:
                        raise ValueError(f"component times scale of {LARGEST:.0f} or more: scores would leave the range of a long")
                    ids.append(i)
                    dims.append(len(x))
                    raw.append(np.floor(scale * x).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "dim", "raw"])

    return run


def _stack(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    one = {c: table.column(c)[:1] for c in ("dim", "block")}
    return pa.table(one | {"ids": pa.array([table.column("id").to_numpy().tobytes()]), "raw": pa.array([b"".join(table.column("raw").to_pylist())], pa.binary())})


def lists_of(x: np.ndarray) -> np.ndarray:
    """For each dimension the rows of x by rising value."""
    return np.argsort(np.ascontiguousarray(x.T), axis=1, kind="stable").astype(np.int32)


def search(ids: np.ndarray, x: np.ndarray, lists: np.ndarray, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a query's k best rows of x, ties to the smaller id; lists: of x by `lists_of`."""
    n = len(ids)
    up, down = np.flatnonzero(q < 0), np.flatnonzero(q > 0)
    seen = ids == query
    left, scores = n - int(seen.sum()), None
    best_id, best = np.zeros(0, np.int64), np.zeros(0, x.dtype)
    depth, step = 0, STEP
    while depth < n and left:
        to = min(depth + step, n)
        new = np.zeros(n, bool)
        if len(up) + len(down):
            new[lists[up, depth:to]] = True
            new[lists[down, n - to : n - depth]] = True
        else:
            new[:] = True
        new &= ~seen
        seen |= new
        met = np.flatnonzero(new)
        left -= len(met)
        # A product over all rows takes less than the copy of many of them.
        if scores is None and 4 * len(met) > n:
            scores = x @ q
        found = x[met] @ q if scores is None else scores[met]
        all_id, all_score = np.append(best_id, ids[met]), np.append(best, found)
        if len(all_score) > k:
            good = all_score >= np.partition(all_score, len(all_score) - k)[len(all_score) - k]
            all_id, all_score = all_id[good], all_score[good]
        top = np.lexsort((all_id, -all_score))[:k]
        best_id, best = all_id[top], all_score[top]
        bound = (x[lists[up, to - 1], up] * q[up]).sum() + (x[lists[down, n - to], down] * q[down]).sum()
        if len(best) == k and bound < best[-1]:
            break
        depth, step = to, 2 * step
    return best_id, best


def _blocks(k: int):
    def run(batches):
        last = None
        for b in batches:
            for row in range(b.num_rows):
                dim = b.column("dim")[row].as_py()
                key = (dim, b.column("block")[row].as_py())
                if key != last:
                    ids = np.frombuffer(b.column("ids")[row].as_py(), np.int64)
                    x = np.frombuffer(b.column("raw")[row].as_py(), np.int64).reshape(len(ids), dim)
                    lists, last = lists_of(x), key
                query_ids = np.frombuffer(b.column("query_ids")[row].as_py(), np.int64)
                queries = np.frombuffer(b.column("queries")[row].as_py(), np.int64).reshape(len(query_ids), dim)
                large = int(np.abs(x).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(dim, 1) >= EXACT
                kind = np.int64 if large else np.float64
                held = x.astype(kind)
                out = [(i, *search(ids, held, lists, i, q.astype(kind), k)) for i, q in zip(query_ids, queries, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(found), i, np.int64) for i, found, _ in out])),
                        pa.array(np.concatenate([found for _, found, _ in out]).astype(np.int64)),
                        pa.array(np.concatenate([s for _, _, s in out]).astype(np.int64)),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return run


def top_k(vectors: DataFrame, queries=None, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest scores: query_id, rank (from 1), vec_id, score.

    queries: condition on the column "id" (default: divisible by 100). Components become floor(scale * x); the score is their inner product, ties go to the
    smaller id. Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. A query meets
    vectors of its own length, and no row with its own id. Of rows with one id, each distinct vector is searched and found once.
    A scaled component of 2**26 or more is an error.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = cut(rows.mapInArrow(_whole(scale), "id long, dim int, raw binary").distinct())
    chosen = whole.where(F.col("id") % 100 == 0 if queries is None else queries)
    blocks = max(1, math.ceil(whole.count() / CANDIDATES))
    parts = max(1, math.ceil(chosen.count() / QUERIES))
    out = "dim int, block long, ids binary, raw binary"
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))
    held = whole.withColumn("block", block).groupBy("dim", "block").applyInArrow(_stack, out)
    asked = chosen.withColumn("block", part).groupBy("dim", "block").applyInArrow(_stack, out)
    asked = asked.select("dim", F.col("ids").alias("query_ids"), F.col("raw").alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    # The stated queries, in blocks, against every block of rows.
    met = held.join(asked, ["dim", "block"]).sortWithinPartitions("dim", "block").select("dim", "block", "ids", "raw", "query_ids", "queries")
    found = met.mapInArrow(_blocks(k), "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
