"""Gradient-boosted trees for many quantile levels, settings, folds and series.

Features are coded into at most `BINS` classes once. A split is found from counts: rows, and rows below the running prediction, per
(node, feature, class); of two sibling nodes only the smaller one is counted, the other is what its parent leaves. A leaf's value is the level's
quantile of its residuals.

Series that a count shows to be short enough for one task are boosted there, a share of the models at a time, all rounds in one
stage. A longer series stays in its blocks: each level of all trees is one pass whose counts travel as keyed rows (model, node,
cell) and are added by Spark, and leaf values come from histograms of residuals that narrow around the wanted rank.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreband.core import broadcast_if_small, parallelism
from foreband.functions.dates import wall_clock, wall_seconds
from foreband.functions.scores import pinball
from foreband.models import passes as P
from foreband.operators.ordered import span_of

BINS = 256
LEAF_BINS = 1024
LEAF_PASSES = 3
RIDGE = 1.0
MIN_ROWS = 2
# Rounds between two rewrites of the running predictions of long series.
SEGMENT = 5
# Rows up to which a series is boosted in one task: some 10 MB with its features.
LOCAL_ROWS = 200_000
# Tree parameters, in bytes, that are sent to every task or added to a block at a time.
TREE_BYTES = 4 << 20


@dataclass(frozen=True)
class Spec:
    """One boosted model: trained on rows with `clock` <= train_upto, tested on those up to test_upto."""

    tau: float
    depth: int = 3
    rate: float = 0.1
    train_upto: float = float("inf")
    test_upto: float = float("inf")


# ---- coding of the features


def feature_edges(df: DataFrame, keys: list[str], features: list[Column], bins: int = BINS) -> DataFrame:
    """Inner class limits per key: array (features) of arrays, from a mergeable quantile sketch."""
    probs = [i / (bins - 1) for i in range(1, bins - 1)]
    cols = [F.percentile_approx(f.cast("double"), probs, 10_000) for f in features]
    return df.groupBy(*keys).agg(F.array(*[F.coalesce(c, F.array().cast("array<double>")) for c in cols]).alias("edges"))


def coded_blocks(
    df: DataFrame, keys: list[str], ts: str, y: str, clock: Column, features: list[Column], edges: DataFrame, span_days: int = 128
) -> DataFrame:
    """Blocks with the time `at`, `y`, `clock` and one byte per (row, feature) in `codes`; class 0 holds missing values."""
    k = len(features)
    row = F.struct(
        wall_seconds(F.col(ts)).alias("at"),
        F.col(y).cast("double").alias("y"),
        clock.cast("double").alias("clock"),
        F.array(*[f.cast("double") for f in features]).alias("x"),
    )
    packed = df.groupBy(*keys, span_of(ts, span_days).alias("block")).agg(F.collect_list(row).alias("_r"))
    blocks = packed.join(broadcast_if_small(edges, 5_000), keys).select(
        *keys, "block", *[F.col("_r")[c].alias(c) for c in ("at", "y", "clock")], F.flatten("_r.x").alias("x"), "edges"
    )
    schema = T.StructType(
        [
            *P.key_fields(blocks, keys),
            *[blocks.schema[c] for c in ("block", "at", "y", "clock")],
            T.StructField("codes", T.BinaryType()),
            P.vector("f"),
        ]
    )

    def code(batches):
        for pdf in batches:
            rows = []
            for key, block in P.block_rows_of(pdf, keys):
                x = np.array(block["x"], dtype=float).reshape(-1, k)
                rows.append((*key, block["block"], block["at"], block["y"], block["clock"], encode(x, block["edges"]).tobytes(), np.zeros(0)))
            yield pd.DataFrame(rows, columns=schema.names)

    return P.run(P.spread(blocks, keys).mapInPandas(code, schema))


def encode(x: np.ndarray, edges) -> np.ndarray:
    codes = np.zeros(x.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(x[:, j])
        codes[known, j] = 1 + np.searchsorted(np.unique(np.asarray(e, dtype=float)), x[known, j], side="left")
    return codes


# ---- trees, kept as rows of numbers: feature, class and gain of the inner nodes, then leaf values


class Shape:
    """Layout of the trees of a batch of models."""

    def __init__(self, specs: list[Spec], features: int):
        self.specs, self.k = specs, features
        self.depth = max(s.depth for s in specs)
        self.inner = 2**self.depth - 1
        self.leaves = 2**self.depth
        self.width = 3 * self.inner + self.leaves
        self.m = len(specs)

    def empty(self) -> np.ndarray:
        tree = np.zeros(self.width)
        tree[: self.inner] = -1
        return tree

    def put(self, tree: np.ndarray, depth: int, feature, cls, gain) -> None:
        """Writes the splits of one level."""
        at = slice(2**depth - 1, 2 ** (depth + 1) - 1)
        tree[at], tree[self.inner :][at], tree[2 * self.inner :][at] = feature, cls, gain

    def node_of(self, codes: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
        """Place (from 0) of every row among the nodes of one level."""
        node = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        for d in range(depth):
            at = 2**d - 1 + node
            feature = tree[at].astype(np.int64)
            right = (feature >= 0) & (codes[rows, np.maximum(feature, 0)] > tree[self.inner + at])
            node = 2 * node + right
        return node

    def leaf_values(self, codes: np.ndarray, tree: np.ndarray) -> np.ndarray:
        return tree[3 * self.inner + self.node_of(codes, tree, self.depth)]

    @property
    def state_width(self) -> int:
        """Numbers of a model in the state of a long series: a segment's trees, a flag per inner node, a lower end per leaf."""
        return SEGMENT * self.width + self.inner + self.leaves

    def state_parts(self, p: np.ndarray):
        """Views of the trees, flags and lower ends in the state of one model or several."""
        a = SEGMENT * self.width
        return p[..., :a].reshape(*p.shape[:-1], SEGMENT, self.width), p[..., a : a + self.inner], p[..., a + self.inner :]

    def codes(self, block: dict) -> np.ndarray:
        return np.frombuffer(block["codes"], dtype=np.uint8).reshape(-1, self.k)

    def running(self, block: dict) -> np.ndarray:
        """Running predictions of a block (models, rows)."""
        n = len(block["y"])
        return np.array(block["f"], dtype=float).reshape(self.m, n) if len(block["f"]) else np.zeros((self.m, n))


def best_splits(n: np.ndarray, below: np.ndarray, tau: float, starts: np.ndarray):
    """Per node the feature (-1: none), the last class that goes left and the gain; also whether the right child has fewer rows.

    n, below: rows and rows under the prediction per (node, cell), the cells of feature j from starts[j] on. The gradient of a
    row is tau, less one if it is below. Counts are whole numbers, so equal gains are equal in any order of adding.
    """
    size = np.diff(starts, append=n.shape[1])
    n_left, b_left = (np.cumsum(x, axis=1) for x in (n, below))
    n_left, b_left = (x - np.repeat(np.append(np.zeros((len(x), 1), x.dtype), x[:, starts[1:] - 1], axis=1), size, axis=1) for x in (n_left, b_left))
    n_all, b_all = n_left[:, size[0] - 1, None], b_left[:, size[0] - 1, None]
    g_left, g_all = tau * n_left - b_left, tau * n_all - b_all
    gain = g_left**2 / (n_left + RIDGE) + (g_all - g_left) ** 2 / (n_all - n_left + RIDGE) - g_all**2 / (n_all + RIDGE)
    gain[(n_left < MIN_ROWS) | (n_all - n_left < MIN_ROWS)] = -np.inf
    best = gain.argmax(axis=1)
    rows = np.arange(len(n))
    value = gain[rows, best]
    good = value > 1e-12
    feature = np.searchsorted(starts, best, "right") - 1
    right_small = np.where(good, 2 * n_left[rows, best] >= n_all[:, 0], True)
    return np.where(good, feature, -1), np.where(good, best - starts[feature], 0), np.where(good, value, 0.0), right_small


def children(parent: np.ndarray, counted: np.ndarray, right_small: np.ndarray) -> np.ndarray:
    """Counts of all children (2 x nodes, cells) from their parents' and those of the smaller child of each."""
    out = np.empty((2 * len(parent), parent.shape[1]), parent.dtype)
    small = 2 * np.arange(len(parent)) + right_small
    out[small], out[small ^ 1] = counted, parent - counted
    return out


def rank_value(residuals: np.ndarray, tau: float) -> float:
    """The smallest residual that at least a share tau of them don't exceed."""
    n = len(residuals)
    if not n:
        return 0.0
    rank = min(n - 1, max(0, math.ceil(tau * n - 1e-9) - 1))
    return float(np.partition(residuals, rank)[rank])


# ---- short series: all rounds of a model in one task


def boost_whole(shape: Shape, spec: Spec, codes: np.ndarray, y: np.ndarray, clock: np.ndarray, rounds: int, keep_at: tuple[int, ...]):
    """Trees (rounds + 1, width) of one model of one series, the level's quantile first, and its predictions after each round of keep_at."""
    used = np.flatnonzero((clock <= spec.train_upto) & ~np.isnan(y))
    starts = np.cumsum(codes.max(axis=0, initial=0).astype(np.int64) + 1)
    cells = int(starts[-1])
    starts = np.append(0, starts[:-1])
    flat, own, known = (codes + starts)[used], codes[used], y[used]
    trees = np.tile(shape.empty(), (rounds + 1, 1))
    trees[0, 3 * shape.inner] = rank_value(known, spec.tau)
    f = np.full(len(y), trees[0, 3 * shape.inner])
    kept = {0: f.copy()} if 0 in keep_at else {}

    def counts(rows, node, nodes, under):
        place = node[:, None] * cells + flat[rows]
        n = np.bincount(place.ravel(), minlength=nodes * cells)
        return np.stack((n, np.bincount(place[under[rows]].ravel(), minlength=nodes * cells))).reshape(2, nodes, cells)

    for r in range(1, rounds + 1):
        tree, under = trees[r], known < f[used]
        node, every = np.zeros(len(used), np.int64), np.arange(len(used))
        for d in range(spec.depth):
            if d == 0:
                sums = counts(every, node, 1, under)
            else:
                rows = np.flatnonzero((node & 1) == right_small[node >> 1])
                small = counts(rows, node[rows] >> 1, 2 ** (d - 1), under)
                sums = np.stack([children(p, c, right_small) for p, c in zip(sums, small)])
            feature, cls, gain, right_small = best_splits(sums[0], sums[1], spec.tau, starts)
            shape.put(tree, d, feature, cls, gain)
            node = 2 * node + ((feature[node] >= 0) & (own[every, np.maximum(feature[node], 0)] > cls[node]))
        node <<= shape.depth - spec.depth  # levels below the model's depth don't split
        residuals = known - f[used]
        for leaf in np.unique(node):
            tree[3 * shape.inner + leaf] = spec.rate * rank_value(residuals[node == leaf], spec.tau)
        f = f + shape.leaf_values(codes, tree)
        if r in keep_at:
            kept[r] = f.copy()
    return trees, kept


def _fit_short(blocks: DataFrame, keys: list[str], shape: Shape, rounds: int, keep_at: tuple[int, ...], series: int) -> tuple[DataFrame, dict]:
    """Trees, and the predictions per block after each round of keep_at."""
    # As many shares of the models as keep all tasks busy; a share gets a copy of its series' codes.
    shares = max(1, min(shape.m, math.ceil(3 * parallelism(blocks.sparkSession) / max(1, series))))
    dealt = blocks.select(*keys, "block", "y", "clock", "codes").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    names = [("block", T.LongType()), ("model_no", T.IntegerType()), ("round", T.IntegerType()), ("tree", T.ArrayType(T.DoubleType())), ("f", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*P.key_fields(blocks, keys), *[T.StructField(n, t) for n, t in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        key, share = [pdf[k].iloc[0] for k in keys], int(pdf["share"].iloc[0])
        codes = np.concatenate([np.frombuffer(c, np.uint8) for c in pdf["codes"]]).reshape(-1, shape.k)
        y, clock = (np.concatenate([np.asarray(v, dtype=float) for v in pdf[c]]) for c in ("y", "clock"))
        ends = np.cumsum([len(v) for v in pdf["y"]])
        rows = []
        for j in range(share, shape.m, shares):
            trees, kept = boost_whole(shape, shape.specs[j], codes, y, clock, rounds, keep_at)
            rows += [(*key, None, j, r, t, None) for r, t in enumerate(trees)]
            for r, f in kept.items():
                rows += [(*key, b, j, r, None, f[e - len(v) : e]) for b, v, e in zip(pdf["block"], pdf["y"], ends)]
        return pd.DataFrame(rows, columns=schema.names)

    found = P.run(dealt.groupBy(*keys, "share").applyInPandas(run, schema))
    held = found.filter("f IS NOT NULL").groupBy(*keys, "block", "round").agg(F.flatten(F.array_sort(F.collect_list(F.struct("model_no", "f"))).getField("f")).alias("f"))
    rest = blocks.drop("f")
    snapshots = {r: rest.join(held.filter(F.col("round") == r).drop("round"), [*keys, "block"]) for r in keep_at}
    return found.filter("tree IS NOT NULL").select(*keys, "model_no", "round", "tree"), snapshots


# ---- long series: passes over blocks


CELLS = {"model_no": T.IntegerType(), "node": T.IntegerType(), "cell": T.IntegerType(), "n": T.LongType(), "below": T.LongType(), "least": T.DoubleType()}


def _cell_rows(keys: list[str], key: tuple, parts: list[tuple], width: int) -> pd.DataFrame:
    """Non-zero cells of one key as rows; parts: (model, rows per node and cell, those below the prediction, least residual)."""
    out = []
    for j, n, below, least in parts:
        at = np.flatnonzero(n)
        out.append((np.full(len(at), j, np.int32), (at // width).astype(np.int32), (at % width).astype(np.int32), n[at].astype(np.int64), below[at].astype(np.int64), least[at]))
    pdf = pd.DataFrame(dict(zip(CELLS, [np.concatenate(c) for c in zip(*out)])))
    for i, k in enumerate(keys):
        pdf.insert(i, k, key[i])
    return pdf


class _Long:
    """Boosting of long series. A state row per (keys, model): `p` holds a segment's trees, a flag per node for the smaller child and the
    lower ends of leaf cells; `sums` the counts of the level just split."""

    def __init__(self, blocks: DataFrame, keys: list[str], shape: Shape):
        self.keys, self.shape = keys, shape
        ends = P.run(blocks.groupBy(*keys).agg(F.min(F.array_min("y")).alias("_lo"), F.max(F.array_max("y")).alias("_hi")))
        self.ends = ends.select(*keys, F.coalesce("_lo", F.lit(0.0)).alias("lo"), F.coalesce("_hi", F.lit(0.0)).alias("hi"))
        self.cells = T.StructType([*P.key_fields(blocks, keys), *[T.StructField(n, t) for n, t in CELLS.items()]])
        self.held = T.StructType(
            [*P.key_fields(blocks, keys), *[T.StructField(n, t) for n, t in (("lo", T.DoubleType()), ("hi", T.DoubleType()), ("model_no", T.IntegerType()))], P.vector("p"), P.vector("sums")]
        )

    def start(self) -> DataFrame:
        """State of a new segment."""
        p = np.concatenate([np.tile(self.shape.empty(), SEGMENT), np.zeros(self.shape.inner + self.shape.leaves)]).tolist()
        models = self.ends.withColumn("model_no", F.explode(F.sequence(F.lit(0), F.lit(self.shape.m - 1))))
        return models.withColumn("p", F.array(*[F.lit(v) for v in p])).withColumn("sums", F.array().cast("array<double>"))

    def attached(self, blocks: DataFrame, state: DataFrame) -> DataFrame:
        """Blocks with the parameters of all models of their key, by broadcast if a count shows that they are few."""
        packed = state.groupBy(*self.keys, "lo", "hi").agg(F.flatten(F.array_sort(F.collect_list(F.struct("model_no", "p"))).getField("p")).alias("p"))
        return blocks.join(broadcast_if_small(packed, max(1, TREE_BYTES // (8 * self.shape.m * self.shape.state_width))), self.keys)

    def counted(self, blocks: DataFrame, state: DataFrame, slot: int, count) -> DataFrame:
        """Cells (keys, model_no, node, cell) with their counts, added within a batch, then by Spark. count(codes, residual, tree, flags, lower
        ends, spec, reach) gives (rows, rows below, least residuals, cells per node)."""
        shape, keys = self.shape, self.keys

        def run(batches):
            for pdf in batches:
                held: dict = {}
                for key, block in P.block_rows_of(pdf, keys):
                    held.setdefault(key, []).append(block)
                for key, own in held.items():
                    p = np.asarray(own[0]["p"], dtype=float).reshape(shape.m, shape.state_width)
                    trees, flags, lows = shape.state_parts(p)
                    codes = np.concatenate([shape.codes(b) for b in own])
                    y, clock = (np.concatenate([np.asarray(b[c], dtype=float) for b in own]) for c in ("y", "clock"))
                    f = np.concatenate([shape.running(b) for b in own], axis=1)
                    reach = (own[0]["lo"], own[0]["hi"])
                    parts, width = [], 1
                    for j, spec in enumerate(shape.specs):
                        rows = np.flatnonzero((clock <= spec.train_upto) & ~np.isnan(y))
                        mine = f[j, rows]
                        for r in range(slot):
                            mine = mine + shape.leaf_values(codes[rows], trees[j, r])
                        found = count(codes[rows], y[rows] - mine, trees[j, slot], flags[j], lows[j], spec, reach)
                        if found is not None:
                            *sums, width = found
                            parts.append((j, *sums))
                    if parts:
                        yield _cell_rows(keys, key, parts, width)

        cells = self.attached(blocks, state).mapInPandas(run, self.cells)
        added = cells.groupBy(*keys, "model_no", "node", "cell").agg(F.sum("n").alias("n"), F.sum("below").alias("below"), F.min("least").alias("least"))
        return added.groupBy(*keys, "model_no").agg(F.collect_list(F.struct("node", "cell", "n", "below", "least")).alias("got"))

    def solved(self, state: DataFrame, counts: DataFrame, solve) -> DataFrame:
        """State after solve(p, sums, node, cell, n, below, least, spec, (lo, hi)) on each of its rows."""
        shape, names = self.shape, self.held.names

        def run(batches):
            for pdf in batches:
                rows = []
                for _, row in P.block_rows_of(pdf, []):
                    got = [] if row["got"] is None else list(row["got"])
                    columns = [np.array([g[c] for g in got], dtype=t) for c, t in (("node", int), ("cell", int), ("n", int), ("below", int), ("least", float))]
                    p, sums = np.array(row["p"], dtype=float), np.array(row["sums"], dtype=float)
                    row["p"], row["sums"] = solve(p, sums, *columns, shape.specs[row["model_no"]], (row["lo"], row["hi"]))
                    rows.append([row[n] for n in names])
                yield pd.DataFrame(rows, columns=names)

        return P.run(state.join(counts, [*self.keys, "model_no"], "left").mapInPandas(run, self.held))

    def split(self, blocks: DataFrame, state: DataFrame, slot: int, d: int) -> DataFrame:
        """Splits the nodes of one level."""
        shape, cells = self.shape, self.shape.k * BINS
        starts = np.arange(shape.k) * BINS

        def count(codes, residual, tree, flags, lows, spec, reach):
            if d >= spec.depth:
                return None
            node = shape.node_of(codes, tree, d)
            if d:
                small = flags[2 ** (d - 1) - 1 :][node >> 1] > 0
                rows = np.flatnonzero((node & 1) == small)
                node, codes, residual = node[rows] >> 1, codes[rows], residual[rows]
            place = node[:, None] * cells + (codes + starts)
            size = max(1, 2 ** (d - 1)) * cells if d else cells
            return np.bincount(place.ravel(), minlength=size), np.bincount(place[residual < 0].ravel(), minlength=size), np.zeros(size), cells

        def solve(p, sums, node, cell, n, below, least, spec, reach):
            if d >= spec.depth:
                return p, sums
            nodes = 2 ** (d - 1) if d else 1
            both = np.zeros((2, nodes * cells))
            both[:, node * cells + cell] = n, below
            both = both.reshape(2, nodes, cells)
            trees, flags, _ = shape.state_parts(p)
            if d:
                parent = sums.reshape(2, nodes, cells)
                small = flags[2 ** (d - 1) - 1 : 2**d - 1] > 0
                both = np.stack([children(a, b, small) for a, b in zip(parent, both)])
            feature, cls, gain, right_small = best_splits(both[0], both[1], spec.tau, starts)
            shape.put(trees[slot], d, feature, cls, gain)
            flags[2**d - 1 : 2 ** (d + 1) - 1] = right_small
            return p, both.ravel() if d + 1 < spec.depth else np.zeros(0)

        return self.solved(state, self.counted(blocks, state, slot, count), solve)

    def leaves(self, blocks: DataFrame, state: DataFrame, slot: int, step: int, base: bool) -> DataFrame:
        """One of LEAF_PASSES passes: the wanted rank's cell is cut into LEAF_BINS cells by the next. The base tree looks for values, the others
        for residuals, which lie within one width of the values on either side."""
        shape, last, cells = self.shape, step == LEAF_PASSES - 1, LEAF_BINS + 2

        def span(reach):
            width = max(reach[1] - reach[0], 1e-12)
            low, width = (reach[0], width) if base else (-width, 2 * width)
            return low, width / LEAF_BINS ** (step + 1)

        def count(codes, residual, tree, flags, lows, spec, reach):
            low, cell_width = span(reach)
            node = shape.node_of(codes, tree, shape.depth)
            place = np.floor((residual - (lows[node] if step else low)) / cell_width) + 1
            # The first and the last cell hold what lies below and above.
            at = node * cells + np.clip(place, 0, cells - 1).astype(np.int64)
            n, least = np.bincount(at, minlength=shape.leaves * cells), np.full(shape.leaves * cells, np.inf)
            np.minimum.at(least, at, residual)
            return n, n, least, cells

        def solve(p, sums, node, cell, n, below, least, spec, reach):
            low, cell_width = span(reach)
            counts, lowest = np.zeros((shape.leaves, cells)), np.zeros((shape.leaves, cells))
            counts[node, cell], lowest[node, cell] = n, least
            trees, _, lows = shape.state_parts(p)
            cum = np.cumsum(counts, axis=1)
            total = cum[:, -1]
            want = np.maximum(np.ceil(spec.tau * total - 1e-9), 1)
            found = np.clip((cum < want[:, None]).sum(axis=1), 1, LEAF_BINS)
            if last:
                value = lowest[np.arange(shape.leaves), found]
                trees[slot, 3 * shape.inner :] = np.where(total > 0, value * (1.0 if base else spec.rate), 0.0)
            lows[:] = (lows if step else low) + (found - 1) * cell_width
            return p, np.zeros(0)

        return self.solved(state, self.counted(blocks, state, slot, count), solve)

    def tree_rows(self, state: DataFrame, slots: int, first_round: int) -> DataFrame:
        width = self.shape.width
        trees = [F.struct(F.lit(first_round + i).alias("round"), F.slice("p", i * width + 1, width).alias("tree")) for i in range(slots)]
        return state.select(*self.keys, "model_no", F.inline(F.array(*trees)))


def _fit_long(blocks: DataFrame, keys: list[str], shape: Shape, rounds: int, keep_at: tuple[int, ...]) -> tuple[DataFrame, dict]:
    work = _Long(blocks, keys, shape)
    trees, snapshots = [], {}
    done = -1  # round 0 is the level's quantile
    while done < rounds:
        stop = min([SEGMENT, rounds - done, *[k - done for k in keep_at if k > done]])
        state, seen = P.run(work.start()), blocks.drop("at")
        for slot in range(stop):
            base = done < 0 and slot == 0
            for d in range(0 if base else shape.depth):
                state = work.split(seen, state, slot, d)
            for step in range(LEAF_PASSES):
                state = work.leaves(seen, state, slot, step, base)
        added = work.tree_rows(state, stop, done + 1)
        blocks = P.run(_advance(blocks, added, keys, shape, stop))
        trees.append(added)
        done += stop
        if done in keep_at:
            snapshots[done] = blocks
    return reduce(DataFrame.unionByName, trees), snapshots


def _advance(blocks: DataFrame, trees: DataFrame, keys: list[str], shape: Shape, rounds: int) -> DataFrame:
    """Blocks with so many rounds of tree rows added to the running predictions."""
    fields = blocks.schema.fields
    names = [f.name for f in fields]
    packed = trees.groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list(F.struct("model_no", "round", "tree"))).getField("tree")).alias("p"))

    def apply(batches):
        for pdf in batches:
            out = pdf[names].copy()
            added = []
            for _, block in P.block_rows_of(pdf, keys):
                f, codes = shape.running(block), shape.codes(block)
                for j, own in enumerate(np.asarray(block["p"], dtype=float).reshape(shape.m, rounds, shape.width)):
                    for tree in own:
                        f[j] += shape.leaf_values(codes, tree)
                added.append(f.ravel())
            out["f"] = added
            yield out

    few = broadcast_if_small(packed, max(1, TREE_BYTES // (8 * shape.m * rounds * shape.width)))
    return blocks.join(few, keys).mapInPandas(apply, T.StructType(fields))


@dataclass
class Boosted:
    """A fitted batch of models: a row per tree (keys, model_no, round, tree), and the blocks with their predictions, model after model."""

    keys: list[str]
    specs: list[Spec]
    features: list[str]
    trees: DataFrame
    blocks: DataFrame
    snapshots: dict[int, DataFrame]

    @property
    def shape(self) -> Shape:
        return Shape(self.specs, len(self.features))


def fit(blocks: DataFrame, keys: list[str], features: list[str], specs: list[Spec], rounds: int, keep_at: tuple[int, ...] = ()) -> Boosted:
    """Boosts all models of all keys for `rounds` rounds.

    `keep_at` names rounds whose predictions are kept as well, so that one run serves several tree counts. The tree of round 0 is the
    level's quantile itself. Leaf values are observed residuals; in long series two residuals within a 2^30th of their range are one.
    """
    shape, keep = Shape(specs, len(features)), tuple(sorted({*keep_at, rounds}))
    sizes = P.run(blocks.groupBy(*keys).agg(F.sum(F.size("y")).alias("_n")))
    long = sizes.filter(F.col("_n") > LOCAL_ROWS).select(*keys)
    n_long, n_all = long.count(), sizes.count()
    parts = []
    if n_long < n_all or not n_all:
        short = blocks.join(broadcast_if_small(long), keys, "left_anti") if n_long else blocks
        parts.append(_fit_short(short, keys, shape, rounds, keep, n_all - n_long))
    if n_long:
        parts.append(_fit_long(blocks.join(broadcast_if_small(long), keys, "left_semi"), keys, shape, rounds, keep))
    trees = reduce(DataFrame.unionByName, [t for t, _ in parts])
    snapshots = {r: reduce(DataFrame.unionByName, [s[r] for _, s in parts]) for r in keep}
    return Boosted(keys, specs, features, trees, snapshots[rounds], snapshots)


def predict(model: Boosted, blocks: DataFrame) -> DataFrame:
    """Adds the predictions of all trees to freshly coded blocks."""
    shape, count = model.shape, model.trees.agg(F.max("round")).first()[0] + 1
    at_once = max(1, TREE_BYTES // (8 * shape.m * shape.width))
    for at in range(0, count, at_once):
        to = min(at + at_once, count)
        blocks = _advance(blocks, model.trees.filter(F.col("round").between(at, to - 1)), model.keys, shape, to - at)
    return blocks


def prediction_rows(blocks: DataFrame, keys: list[str], specs: list[Spec], test_only: bool = True) -> DataFrame:
    """One row per (keys, model, ts): `model_no`, tau, y, q."""
    models = F.array(
        *[F.struct(F.lit(j).alias("model_no"), F.lit(s.tau).alias("tau"), F.lit(s.train_upto).alias("_a"), F.lit(s.test_upto).alias("_b")) for j, s in enumerate(specs)]
    )
    n = F.size("y")
    each = blocks.select(*keys, "at", "y", "clock", "f", F.inline(models))
    rows = F.arrays_zip("at", "y", "clock", F.slice("f", F.col("model_no") * n + 1, n).alias("q"))
    if test_only:
        rows = F.filter(rows, lambda r: (r["clock"] > F.col("_a")) & (r["clock"] <= F.col("_b")))
    flat = each.select(*keys, "model_no", "tau", F.inline(rows))
    return flat.select(*keys, "model_no", "tau", wall_clock(F.col("at")).alias("ts"), "y", "q")


def test_losses(blocks: DataFrame, keys: list[str], specs: list[Spec]) -> DataFrame:
    """Doubled pinball score on each model's test rows: keys, model_no, loss, n."""
    rows = prediction_rows(blocks, keys, specs).filter("y IS NOT NULL")
    loss = 2 * pinball(F.col("y"), F.col("q"), F.col("tau"))
    return rows.groupBy(*keys, "model_no").agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def importance(model: Boosted) -> DataFrame:
    """Mean gain per split of each feature, scaled to sum to one: keys, model_no, feature, importance, splits."""
    shape, keys = model.shape, model.keys
    names = F.array(*[F.lit(n) for n in model.features])
    splits = F.arrays_zip(F.slice("tree", 1, shape.inner).alias("j"), F.slice("tree", 2 * shape.inner + 1, shape.inner).alias("gain"))
    found = model.trees.select(*keys, "model_no", F.inline(splits)).filter("j >= 0")
    found = found.withColumn("feature", F.element_at(names, (F.col("j") + 1).cast("int")))
    gains = found.groupBy(*keys, "model_no", "feature").agg(F.avg("gain").alias("gain"), F.count("gain").alias("splits"))
    total = gains.groupBy(*keys, "model_no").agg(F.sum("gain").alias("_t"))
    return gains.join(total, [*keys, "model_no"]).select(*keys, "model_no", "feature", (F.col("gain") / F.col("_t")).alias("importance"), "splits")


# ---- persistence


def save(model: Boosted, path: str) -> None:
    """All trees as one table; settings and features are rows of two small ones."""
    model.trees.write.parquet(f"{path}/trees")
    spark = model.blocks.sparkSession
    rows = [(i, s.tau, s.depth, s.rate, s.train_upto, s.test_upto) for i, s in enumerate(model.specs)]
    spark.createDataFrame(rows, "model_no int, tau double, depth int, rate double, train_upto double, test_upto double").write.parquet(f"{path}/specs")
    spark.createDataFrame([(i, n) for i, n in enumerate(model.features)], "place int, feature string").write.parquet(f"{path}/features")


def load(blocks: DataFrame, keys: list[str], path: str) -> Boosted:
    spark = blocks.sparkSession
    specs = [Spec(*r[1:]) for r in spark.read.parquet(f"{path}/specs").orderBy("model_no").collect()]
    names = [r[1] for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
    return Boosted(keys, specs, names, spark.read.parquet(f"{path}/trees"), blocks, {})
