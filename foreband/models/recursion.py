"""Linear recursions over series that are cut into blocks.

A recursion s_t = u_t + a_1 s_(t-1) + ... + a_d s_(t-d) is linear in its starting values. Every block is
therefore summarised from zero starting values on its own task, the summaries of a series (one per block)
are chained, and every block is run again from its true starting values. That is exact and no task
sees more than one block of observations. Series that fit one block skip the chaining.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreband.core import broadcast_if_small
from foreband.models import passes as P

# inputs(block, p) -> a (candidates, depth), u (own rows, candidates)
Inputs = Callable[[dict, np.ndarray], tuple[np.ndarray, np.ndarray]]
# Blocks whose maps are combined at a time.
FAN = 32
# Whether series of one block climb in one stage.
AT_ONCE = True
# initial(p) -> starting values (candidates, depth), latest first
Initial = Callable[[np.ndarray], np.ndarray]


def scan(a: np.ndarray, u: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs the recursion; returns all values (rows, candidates) and the last `depth`, latest first."""
    depth = a.shape[1]
    used = np.flatnonzero(a.any(axis=0))
    terms = [np.ascontiguousarray(a[:, j]) for j in range(used[-1] + 1)] if len(used) else []
    out = np.empty_like(u)
    hist = [start[:, j] for j in range(len(terms))]
    for t, v in enumerate(u):
        for coef, past in zip(terms, hist):
            v = v + coef * past
        out[t] = v
        if terms:
            hist = [v, *hist[:-1]]
    last = np.concatenate([out[::-1][:depth].T, start], axis=1)[:, :depth]
    return out, last


def transition(a: np.ndarray, steps: int) -> np.ndarray:
    """How starting values of one act on the last values after `steps` rows: powers of the companion matrix."""
    c, d = a.shape
    m = np.zeros((c, d, d))
    m[:, 0, :] = a
    m[:, np.arange(1, d), np.arange(d - 1)] = 1.0
    return np.linalg.matrix_power(m, steps)


def last_block(blocks: DataFrame) -> int:
    """Number of the last block of the longest series."""
    return blocks.agg(F.max("block")).first()[0] or 0


def _rows_of(blocks: DataFrame, keys: list[str], *columns: str) -> T.StructType:
    return T.StructType([*P.key_fields(blocks, keys), blocks.schema["block"], *[P.vector(c) for c in columns]])


def starts(blocks: DataFrame, state: DataFrame, keys: list[str], inputs: Inputs, initial: Initial, depth: int, last: int) -> DataFrame:
    """Starting values `s0` per (keys, block).

    A block acts on starting values as an affine map. Maps of up to FAN neighbours are combined at a time, level by level, until one is left per
    series; the starting values then go down the same tree. So no group holds more than FAN maps, however long a series is.
    """
    nodes = _rows_of(blocks, keys, "p", "m", "f")

    def summarise(batches):
        for pdf in batches:
            rows = []
            for key, block in P.block_rows_of(pdf, keys):
                p = np.asarray(block["p"], dtype=float)
                a, u = inputs(block, p)
                _, end = scan(a, u, np.zeros((len(a), depth)))
                # the parameters are read once, from the first block
                first = p if block["block"] == 0 else np.zeros(0)
                rows.append((*key, block["block"], first, transition(a, len(u)).ravel(), end.ravel()))
            yield pd.DataFrame(rows, columns=nodes.names)

    def maps(pdf: pd.DataFrame):
        """The maps of the rows in order: (matrix, offset) with one matrix per candidate."""
        for m, f in zip(pdf["m"], pdf["f"]):
            f = np.asarray(f).reshape(-1, depth)
            yield np.asarray(m).reshape(len(f), depth, depth), f

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        total = None
        for m, f in maps(pdf):
            total = (m, f) if total is None else (m @ total[0], np.einsum("cij,cj->ci", m, total[1]) + f)
        out = pdf[[*keys, "block"]].iloc[:1].copy()
        out["block"] //= FAN
        out["p"], out["m"], out["f"] = [pdf["p"].iloc[0]], [total[0].ravel()], [total[1].ravel()]
        return out[nodes.names]

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        start = pdf["up"].iloc[0]
        now = initial(np.asarray(pdf["p"].iloc[0], dtype=float)) if start is None else np.asarray(start, dtype=float).reshape(-1, depth)
        found = []
        for m, f in maps(pdf):
            found.append(now.ravel())
            now = np.einsum("cij,cj->ci", m, now) + f
        out = pdf[[*keys, "block"]].copy()
        out["s0"] = found
        return out

    parent = F.floor(F.col("block") / F.lit(FAN)).cast("int")
    levels = [P.run(P.attach_state(blocks, state, keys).mapInPandas(summarise, nodes))]
    while last >= FAN:
        last //= FAN
        levels.append(P.run(levels[-1].groupBy(*keys, parent.alias("_up")).applyInPandas(combine, nodes)))
    schema = _rows_of(blocks, keys, "s0")
    found = None
    for level in reversed(levels):
        if found is None:
            below = level.withColumn("up", F.lit(None).cast("array<double>"))
        else:
            above = found.select(*keys, F.col("block").alias("_up"), F.col("s0").alias("up"))
            below = level.withColumn("_up", parent).join(above, [*keys, "_up"]).drop("_up")
        found = below.groupBy(*keys, parent.alias("_up")).applyInPandas(descend, schema)
    return found


def with_starts(
    blocks: DataFrame, state: DataFrame, keys: list[str], inputs: Inputs, initial: Initial, depth: int, last: int
) -> DataFrame:
    """Blocks with their starting values; series of one block start from the initial ones."""
    if not last:
        return blocks.withColumn("s0", F.lit(None).cast("array<double>"))
    found = P.run(starts(blocks, state, keys, inputs, initial, depth, last))
    return blocks.join(broadcast_if_small(found), [*keys, "block"])


def run_block(block: dict, p: np.ndarray, inputs: Inputs, initial: Initial) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of one block from its starting values: (rows, candidates), the values before and after it."""
    a, u = inputs(block, p)
    s0 = initial(p) if block["s0"] is None else np.asarray(block["s0"], dtype=float).reshape(a.shape)
    values, last = scan(a, u, s0)
    return values, s0, last


def filtered_sums(
    blocks: DataFrame, state: DataFrame, keys: list[str], inputs: Inputs, initial: Initial, depth: int, mapper, reducer, last: int
) -> DataFrame:
    """One pass whose mapper sees the filtered values: mapper(block, p, values) -> vector."""
    known = state if not last or isinstance(state, list) else P.state_hint(blocks, keys)(P.as_frame(state, blocks, keys))
    ready = with_starts(blocks, known, keys, inputs, initial, depth, last)
    return P.step(
        ready, state, keys, lambda block, p: mapper(block, p, run_block(block, p, inputs, initial)[0]), reducer
    )


def search(
    blocks: DataFrame,
    state: DataFrame | list[float],
    keys: list[str],
    inputs: Inputs,
    initial: Initial,
    depth: int,
    mapper,
    reducer,
    rounds: int,
    cut_every: int = 3,
) -> DataFrame:
    """Repeats a filtered pass, the reducer moving the candidates in `p`."""
    last = last_block(blocks)
    hint = P.state_hint(blocks, keys)
    for i in range(rounds):
        state = filtered_sums(blocks, hint(state), keys, inputs, initial, depth, mapper, reducer, last)
        if (i + 1) % cut_every == 0 or i + 1 == rounds or last:
            state = P.run(state)
    return P.as_frame(state, blocks, keys)


def climb(
    blocks: DataFrame, state: DataFrame | P.Few, keys: list[str], inputs: Inputs, initial: Initial, depth: int, mapper, reducer, done: Callable, limit: int
) -> DataFrame | P.Few:
    """Repeats a filtered pass until done(p) holds for every key, or `limit` passes are over, which is left for the caller to see.

    Series of one block, as a look at the blocks shows, climb in the task that holds the block, all passes in one stage.
    """
    last = last_block(blocks)
    if AT_ONCE and not last:
        return _climb_at_once(blocks, state, keys, inputs, initial, mapper, reducer, done, limit)
    hint = P.state_hint(blocks, keys)
    for _ in range(limit):
        state = P.run(filtered_sums(blocks, hint(state), keys, inputs, initial, depth, mapper, reducer, last))
        if isinstance(state, P.Few):
            left = not all(done(p) for p in state.values.values())
        else:
            open_ = state.select("p").mapInPandas(lambda it: (pdf[[not done(np.asarray(p, dtype=float)) for p in pdf["p"]]].assign(p=1) for pdf in it), "p int")
            left = open_.limit(1).count() > 0
        if not left:
            break
    return state


def _climb_at_once(blocks: DataFrame, state, keys: list[str], inputs, initial, mapper, reducer, done, limit: int) -> DataFrame:
    ready = with_starts(P.attach_state(blocks, P.state_hint(blocks, keys)(P.as_frame(state, blocks, keys)), keys), state, keys, inputs, initial, 0, 0)
    schema = T.StructType([*P.key_fields(blocks, keys), P.vector("p")])

    def run(batches):
        for pdf in batches:
            rows = []
            for key, block in P.block_rows_of(pdf, keys):
                p = np.array(block["p"], dtype=float)
                for _ in range(limit):
                    p = reducer(p, mapper(block, p, run_block(block, p, inputs, initial)[0]))
                    if done(p):
                        break
                rows.append((*key, p))
            yield pd.DataFrame(rows, columns=schema.names)

    return P.run(P.spread(ready, keys).mapInPandas(run, schema))


class Climber:
    """Maximises `m` log-likelihoods of up to `n` parameters each that share a pass, by damped scoring.

    A pass evaluates every trial point and, for its scores, a small step along each axis. The summed outer product of an observation's scores
    stands for the Hessian (Berndt, Hall, Hall and Hausman). A trial that raises the likelihood becomes the centre; else the damping grows. An order is done
    when the gain that its quadratic model promises is below `tol`, or no step raises the likelihood any more.
    State per problem: centre, trial, best value, damping, rounds, done, gradient and outer product at the centre.
    """

    H = 1e-5

    def __init__(self, used: np.ndarray, tol: float = 1e-4):
        self.used, self.tol = used, tol
        self.m, self.n = used.shape
        self.size = 2 * self.n + 4 + self.n + self.n**2
        self.moves = np.concatenate([np.zeros((1, self.n)), self.H * np.eye(self.n)])

    def view(self, p: np.ndarray) -> dict[str, np.ndarray]:
        s, n = p.reshape(self.m, self.size), self.n
        names = {"centre": slice(0, n), "trial": slice(n, 2 * n), "best": 2 * n, "damp": 2 * n + 1, "rounds": 2 * n + 2, "done": 2 * n + 3, "g": slice(2 * n + 4, 3 * n + 4)}
        return {k: s[:, v] for k, v in names.items()} | {"h": s[:, 3 * n + 4 :].reshape(self.m, n, n)}

    def at(self, points: np.ndarray) -> np.ndarray:
        """A state that starts from the given points."""
        p = np.zeros(self.m * self.size)
        v = self.view(p)
        v["centre"][:], v["trial"][:], v["best"][:], v["damp"][:] = points, points, -np.inf, 1e-2
        return p

    def open(self, p: np.ndarray) -> np.ndarray:
        """The problems that are not done."""
        return np.flatnonzero(self.view(p)["done"] == 0)

    def candidates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(open problems * (n + 1), n): each trial and its neighbours; and the problem of each."""
        at = self.open(p)
        return (self.view(p)["trial"][at, None, :] + self.moves).reshape(-1, self.n), np.repeat(at, self.n + 1)

    def scores(self, p: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of one block from its log-likelihoods (rows, candidates)."""
        at = self.open(p)
        v = values.reshape(len(values), len(at), self.n + 1)
        s = np.where(self.used[at], (v[:, :, 1:] - v[:, :, :1]) / self.H, 0.0).transpose(1, 0, 2)
        out = np.zeros((self.m, 1 + self.n + self.n**2))
        out[at] = np.concatenate([v[:, :, 0].sum(axis=0)[:, None], s.sum(axis=1), (s.transpose(0, 2, 1) @ s).reshape(len(at), self.n**2)], axis=1)
        return out.ravel()

    def update(self, p: np.ndarray, sums: np.ndarray) -> np.ndarray:
        p = p.copy()
        v, s = self.view(p), sums.reshape(self.m, -1)
        open_ = v["done"] == 0
        better = open_ & np.isfinite(s).all(axis=1) & (s[:, 0] > v["best"])
        v["rounds"][open_] += 1
        v["centre"][better], v["best"][better] = v["trial"][better], s[better, 0]
        v["g"][better], v["h"][better] = s[better, 1 : self.n + 1], s[better, self.n + 1 :].reshape(-1, self.n, self.n)
        v["damp"][:] = np.where(better, np.maximum(v["damp"] / 4, 1e-8), v["damp"] * 6)
        for i in np.flatnonzero(open_):
            use = self.used[i]
            g, h = v["g"][i, use], v["h"][i][np.ix_(use, use)]
            scale = np.maximum(np.diag(h), 1e-8)
            gain = 0.5 * g @ np.linalg.pinv(h + np.diag(1e-10 * scale), hermitian=True) @ g
            step = np.linalg.solve(h + np.diag(v["damp"][i] * scale + 1e-10), g)
            v["trial"][i] = v["centre"][i]
            v["trial"][i, use] += np.clip(step, -2, 2)
            v["done"][i] = float(np.isfinite(v["best"][i]) and (gain < self.tol or v["damp"][i] > 1e8))
        return p

    def finished(self, p: np.ndarray) -> bool:
        return bool((self.view(p)["done"] > 0).all())


# ---- compass search over several starting points at once


class Compass:
    """Pattern search for `m` independent problems of dimension `n` that share one pass.

    State vector: per problem the centre (n), the step size and the best value. Every round tries the centre and one
    step up and down along each axis; without an improvement the step is halved.
    """

    def __init__(self, m: int, n: int, start: np.ndarray, step: float = 1.0):
        self.m, self.n, self.first, self.step = m, n, np.asarray(start, dtype=float), step
        self.moves = np.concatenate([np.zeros((1, n)), np.eye(n), -np.eye(n)])
        self.size = m * (n + 2)

    def initial(self) -> np.ndarray:
        start = np.broadcast_to(self.first, (self.m, self.n))
        return np.column_stack([start, np.full(self.m, self.step), np.full(self.m, -np.inf)]).ravel()

    def candidates(self, p: np.ndarray) -> np.ndarray:
        """(m * moves, n), problems in order."""
        s = p.reshape(self.m, self.n + 2)
        return (s[:, None, : self.n] + self.moves[None] * s[:, None, self.n : self.n + 1]).reshape(-1, self.n)

    def update(self, p: np.ndarray, values: np.ndarray) -> np.ndarray:
        """New state from the value (to be maximised) of every candidate."""
        s = p.reshape(self.m, self.n + 2).copy()
        tried = self.candidates(p).reshape(self.m, -1, self.n)
        values = np.where(np.isfinite(values), values, -np.inf).reshape(self.m, -1)
        best = values.argmax(axis=1)
        rows = np.arange(self.m)
        moved = best > 0
        s[:, : self.n] = tried[rows, best]
        s[:, self.n] = np.where(moved, s[:, self.n] * 1.2, s[:, self.n] * 0.5)
        s[:, self.n + 1] = values[rows, best]
        return s.ravel()
