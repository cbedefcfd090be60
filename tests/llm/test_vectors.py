"""Clustering and near-duplicates of embeddings against brute force; nulls, empties, ties, repeated rows, odd lengths, clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foreband.llm import centroids, near_vectors
from foreband.llm.common import table

ODD = "vec_id long, embedding array<double>, label int, cls string, distance double, root long, digest int, x int"


def odd(rows):
    return [(i, v, label, "c", 0.5, 7, 1, 2) for i, v, label in rows]


# 11: clustering


def clustered(rows, k=8, rounds=10):
    """Rows of the contract by Python integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    c = [v for _, _, v in start]
    if not c:
        return []

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [near(v) for _, v in kept]
    sums = [sum(d for d, j in found if j == n) for n in range(len(c))]
    said = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, sums[j], sum(sums), said[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def test_clusters_of_the_table(spark, root):
    df = table(spark, root, "embeddings")
    got = sorted((tuple(r) for r in centroids.cluster(df).collect()), key=str)
    assert got == clustered([(r.vec_id, r.embedding) for r in df.collect()])


def test_clusters_of_odd_rows(spark):
    r = random.Random(2)
    full = lambda: [r.choice((-0.25, 0.0, 1 / 3, 2.5)) for _ in range(64)]
    same = full()
    rows = [(i, full()) for i in range(30)] + [(40, same)] * 4 + [(41, same), (41, full()), (None, full()), (None, same)]
    rows += [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [None] + [1.0] * 63), (55, [math.nan] * 64), (56, [math.inf] + [0.0] * 63), (57, [0.0] * 64), (58, [-0.0] * 64)]
    df = spark.createDataFrame(odd([(i, v, 1) for i, v in rows]), ODD).repartition(3)
    assert sorted((tuple(x) for x in centroids.cluster(df).collect()), key=str) == clustered(rows)
    few = rows[:3] + rows[40:]
    df = spark.createDataFrame(odd([(i, v, 1) for i, v in few]), ODD)
    assert sorted((tuple(x) for x in centroids.cluster(df).collect()), key=str) == clustered(few)


def test_clusters_of_nothing(spark):
    empty = centroids.cluster(spark.createDataFrame([], ODD))
    assert empty.collect() == [] and empty.columns[:3] == ["vec_id", "cluster", "distance"]
    assert centroids.cluster(spark.createDataFrame(odd([(None, [1.0] * 64, 1), (1, None, 1)]), ODD)).collect() == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="component times scale"):
        centroids.cluster(spark.createDataFrame(odd([(1, [1e300] * 64, 1)]), ODD)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 9), st.sampled_from([1, 3, 1000, (1 << 24) - 1]))
def test_progressive_search_is_exact(seed, k, size):
    r = np.random.default_rng(seed)
    x, c = r.integers(-size, size + 1, (50, 64)), r.integers(-size, size + 1, (k, 64))
    c[r.integers(k)] = c[0]
    x[:k] = c
    distance = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    best, far = centroids.nearest(x, c)
    assert best.tolist() == distance.argmin(axis=1).tolist() and far.tolist() == distance.min(axis=1).tolist()


def test_transform_keeps_distances_and_orders_by_sign_changes():
    x = np.random.default_rng(1).integers(-99, 99, (5, 64))
    basis = centroids.transform(np.eye(64, dtype=np.int64))
    assert (centroids.transform(x) == x @ basis.T).all() and ((centroids.transform(x) ** 2).sum(axis=1) == 64 * (x**2).sum(axis=1)).all()
    changes = (np.diff(basis, axis=1) != 0).sum(axis=1)
    assert changes[centroids.ORDER].tolist() == list(range(64))


# 13: near-duplicates


def linked(rows, least=0.93):
    """(id, links, component, kept) by comparing all pairs."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [None] * n
    for i, (_, v, _) in enumerate(rows):
        if good[i]:
            x = np.array(v, float)
            x = x / np.abs(x).max()
            unit[i] = x / math.sqrt(math.fsum(x * x))
    near = [[j for j in range(n) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def found(df, **args):
    return sorted((tuple(r) for r in near_vectors.near_duplicates(df, **args).collect()), key=str)


def cloud(seed, n, noise, dim=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(1, n // 12), dim))
    return [(centres[r.integers(len(centres))] + noise * r.standard_normal(dim)).tolist() for _ in range(n)]


def odd_vectors():
    rows = [(i, v, i % 2) for i, v in enumerate(cloud(4, 150, 0.15))]
    rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(205, [2 * x for x in rows[0][1]], 0), (206, rows[0][1], 1), (207, rows[0][1], None)]
    rows += [(300, [1.0, 0.0], 0), (301, [1.0, -0.0], 0), (302, [1e300, 1e300], 0), (303, [1e-300, 1e-300], 0), (304, [5e-324, 0.0], 0)]
    rows += [(310, None, 0), (311, [], 0), (312, [0.0] * 16, 0), (313, [math.nan] * 16, 0), (314, [math.inf] + [1.0] * 15, 0), (315, [None] * 16, 0)]
    return rows + [(316, rows[3][1], 1)] * 3 + [(None, rows[3][1], 1), (None, [3.0, -4.0], 0), (None, None, None)]


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(odd(rows), ODD).repartition(3)
    assert found(df) == linked(rows)
    assert found(df, label_col=None) == linked([(i, v, 0) for i, v, _ in rows])


def test_near_duplicates_of_the_table(spark, root):
    df = table(spark, root, "embeddings")
    assert found(df) == linked([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_near_duplicates_of_nothing(spark):
    assert near_vectors.near_duplicates(spark.createDataFrame([], ODD)).collect() == []
    rows = odd([(1, None, 1), (2, [0.0], 1), (None, [1.0], None)])
    assert sorted(map(str, (tuple(r) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, ODD)).collect()))) == ["(1, 0, 1, True)", "(2, 0, 2, True)", "(None, 0, None, True)"]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 40), st.integers(1, 3))
def test_tables_and_chunks_add_up(seed, m, chunks):
    """Every pair that shares a bucket in some table counts once, over tables and over the cells of two chunks."""
    r = np.random.default_rng(seed)
    x = np.array(cloud(seed, m, 0.3, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    n, codes, part = r.integers(1, 4, m), r.integers(0, 2, (m, 3)), r.integers(0, chunks, m)
    near = (x @ x.T >= 0.8) & (codes[:, None, :] == codes[None, :, :]).any(axis=2) & ~np.eye(m, dtype=bool)
    total, edges = np.zeros(m, np.int64), set()
    for t in range(3):
        for code in (0, 1):
            for i in range(chunks):
                for j in range(i, chunks):
                    own = np.flatnonzero((codes[:, t] == code) & ((part == i) | (part == j)))
                    weight, root = near_vectors.linked(x[own], codes[own], n[own], t, part[own] if i != j else None, 0.8)
                    total[own] += weight
                    edges |= {(own[a], own[b]) for a, b in enumerate(root)}
    assert total.tolist() == (near @ n).tolist()
    low = list(range(m))
    for _ in range(m):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    want = list(range(m))
    for _ in range(m):
        for a in range(m):
            want[a] = min([want[a]] + [want[b] for b in np.flatnonzero(near[a])])
    assert low == want


def test_layout_grows_with_the_largest_label():
    for classes in (0, 1, 5_000, 10**6, 10**9):
        planes, tables = near_vectors.layout(classes, 0.93)
        same = (1 - math.acos(0.93) / math.pi) ** planes
        assert (1 - same) ** tables <= near_vectors.MISS and classes / 2**planes <= near_vectors.BUCKET
    assert near_vectors.layout(10, 1.0) == (4, 1)
