"""Embedding near-duplicates by random-hyperplane sign hashing (operator 13).

Vectors that are equal and share a label are one class. Each of L tables cuts the space by k random planes; the signs are a class's bucket
in that table. Buckets go to tasks whole, or in cells of two chunks where they are large; a cell compares its members by matrix products in
double precision. A pair counts in the first table that holds it in one bucket, so that link counts add up without pairs ever leaving the
task. Links go out as one row per class: the weight of its partners and the cell's smallest member it hangs together with.
k follows the largest label's class count, L the probability to miss a pair that lies right at the threshold.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.core import broadcast_if_small
from foreband.llm.common import cut, grouped, joined_hot, prepare

# Classes a bucket should hold on average, and the most of one bucket that a chunk should hold.
BUCKET, CHUNK = 1024, 4096
# Largest probability to miss a pair at the threshold.
MISS = 0.002
FEWEST_PLANES, MOST_PLANES = 4, 30
# Cosines this close to the threshold are computed again one by one.
CLOSE = 1e-9
ROWS = 512


def layout(classes: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """(planes, tables) for so many classes under one label."""
    planes = min(MOST_PLANES, max(FEWEST_PLANES, math.ceil(math.log2(max(1, classes) / BUCKET))))
    same = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** planes
    return planes, 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))


@lru_cache(maxsize=16)
def _planes(dim: int, planes: int, tables: int) -> np.ndarray:
    return np.random.default_rng([20260113, dim]).standard_normal((dim, planes * tables))


def _described(single: bool):
    kind = np.float32 if single else np.float64

    def run(batches):
        for b in batches:
            labels, column = b.column("label").to_pylist(), b.column("vector")
            dims, digests, raws = [], [], []
            for label, v in zip(labels, column, strict=True):
                dim, digest, raw = None, None, None
                if label is not None and v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy().astype(kind) + kind(0)  # no negative zero
                    if np.isfinite(x).all() and x.any():
                        dim, raw = len(x), x.tobytes()
                        digest = hashlib.blake2b(f"{dim} {label}\0".encode() + raw, digest_size=16).digest()
                dims.append(dim)
                digests.append(digest)
                raws.append(raw)
            cls = [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digests]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(cls, pa.int64()), pa.array(raws, pa.binary())],
                ["id", "label", "dim", "digest", "cls", "raw"],
            )

    return run


def units(raws: list[bytes], dim: int, single: bool) -> np.ndarray:
    """Vectors of length one in double precision; the largest component is brought near 1 first, so that squares stay in range."""
    x = np.frombuffer(b"".join(raws), np.float32 if single else np.float64).reshape(len(raws), dim).astype(float)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _buckets(planes: int, tables: int, single: bool, whole: bool):
    """One row per class and table: its slot, and with `whole` the codes in all tables and the vector."""
    weights = 1 << np.arange(planes, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                dims, raws = b.column("dim").to_numpy(), b.column("raw").to_pylist()
                codes = np.zeros((b.num_rows, tables), np.int64)
                for dim in np.unique(dims):
                    here = np.flatnonzero(dims == dim)
                    signs = units([raws[i] for i in here], dim, single) @ _planes(int(dim), planes, tables) > 0
                    codes[here] = (signs.reshape(len(here), tables, planes) * weights).sum(axis=2)
                slots = (codes + (np.arange(tables, dtype=np.int64) << 40)).ravel()
                take = pa.array(np.repeat(np.arange(b.num_rows), tables))
                names = ["label", "dim", "cls", "n", "raw"] if whole else ["label", "dim"]
                columns = [b.column(c).take(take) for c in names] + [pa.array(slots)]
                if whole:
                    columns.append(pa.array([c.tobytes() for c in codes.astype(np.int32)], pa.binary()).take(take))
                yield pa.RecordBatch.from_arrays(columns, names + ["slot", "codes"][: 2 if whole else 1])

    return run


def linked(x: np.ndarray, codes: np.ndarray, n: np.ndarray, table: int, part: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For a cell's members: the weight of the partners each links to for the first time in this table, and the place of the first member
    that it hangs together with. part: in a cell of two chunks the members' chunks, so that only pairs across count."""
    m = len(x)
    weight, root = np.zeros(m, np.int64), np.arange(m)
    for at in range(0, m, ROWS):
        cosine = x[at : at + ROWS] @ x[at:].T
        rows, cols = np.nonzero(cosine >= least - CLOSE)
        exact = cosine[rows, cols]
        rows, cols = rows + at, cols + at
        keep = cols > rows
        if part is not None:
            keep &= part[rows] != part[cols]
        unsure = np.flatnonzero(keep & (exact < least + CLOSE))
        if len(unsure):
            keep[unsure] = np.einsum("ij,ij->i", x[rows[unsure]], x[cols[unsure]]) >= least
        for t in range(table):
            keep &= codes[rows, t] != codes[cols, t]
        rows, cols = rows[keep], cols[keep]
        if not len(rows):
            continue
        np.add.at(weight, rows, n[cols])
        np.add.at(weight, cols, n[rows])
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            met = np.unique(np.append(root[cols[a:b]], root[rows[a]]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return weight, root


def _cell(least: float, single: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        dim, slot = table.column("dim")[0].as_py(), table.column("slot")[0].as_py()
        x = units(table.column("raw").to_pylist(), dim, single)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int32).reshape(len(x), -1)
        cls, n = (table.column(c).to_numpy() for c in ("cls", "n"))
        part = None if table.column("low")[0] == table.column("high")[0] else table.column("chunk").to_numpy()
        weight, root = linked(x, codes, n, slot >> 40, part, least)
        found = np.flatnonzero(weight)
        return pa.table({"cls": cls[found], "links": weight[found], "root": cls[root[found]]})

    return run


def near_duplicates(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", miss: float = MISS
) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is `least` or more; without
    label_col all rows may link. n_links counts the other rows linked directly, equal vectors and repeated rows included; component_id is the smallest id
    reachable by links, itself included. A pair at the threshold is missed with probability `miss`, a closer one less often; no pair
    below it links. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. A row without an id links as others do, and has the smallest id of its component; one of ids that are all null
    is null. kept: the id is the component's, or neither is there. Other columns are not read; an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("vector"))
    described = rows.mapInArrow(_described(single), "id long, label string, dim int, digest binary, cls long, raw binary")
    narrow = cut(described.select("id", "digest"))
    kinds = [F.first(c).alias(c) for c in ("label", "dim", "cls", "raw")]
    classes = cut(described.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"), *kinds))

    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    planes, tables = layout(largest or 0, least, miss)
    place = ["label", "dim", "slot"]
    members = classes.select("label", "dim", "cls", "n", "raw")
    counts = members.mapInArrow(_buckets(planes, tables, single, False), "label string, dim int, slot long").groupBy(*place).count()
    large = cut(counts.where(F.col("count") > CHUNK).select(*place, F.ceil(F.col("count") / CHUNK).alias("chunks")))
    index = members.mapInArrow(_buckets(planes, tables, single, True), "label string, dim int, cls long, n long, raw binary, slot long, codes binary")
    if large.limit(1).count():
        # A member of chunk c meets every chunk d of its bucket in the cell (lower, higher) of the two.
        index = index.join(broadcast_if_small(large), place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        index = index.withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    else:
        index = index.withColumn("chunk", F.lit(0).cast("long")).withColumn("other", F.lit(0).cast("long"))
    index = index.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    found = cut(index.groupBy(*place, "low", "high").applyInArrow(_cell(least, single), "cls long, links long, root long"))

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = grouped(found.where("cls != root").select(F.col("root").alias("a"), F.col("cls").alias("b")))
    member = classes.select("digest", "cls", "first", "n").join(links, "cls", "left").join(groups.withColumnRenamed("id", "cls"), "cls", "left")
    member = cut(member.withColumn("component", F.coalesce("component", "cls")))
    lowest = member.groupBy("component").agg(F.min("first").alias("lowest"))
    info = member.join(lowest, "component").select("digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "lowest")
    out = joined_hot(narrow.where("digest is not null"), info, "digest", "n", narrow.count()).select("id", "links", "lowest")
    out = out.unionByName(narrow.where("digest is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("lowest")))
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("lowest").alias("component_id"), F.col("id").eqNullSafe(F.col("lowest")).alias("kept"))
