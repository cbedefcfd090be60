"""Least squares, stepwise selection and linear quantile regression from weighted Gram sums."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreband import LEVELS
from foreband.core import broadcast_if_small
from foreband.models import passes as P


def dummies(col: Column, values) -> list[Column]:
    """0/1 columns for every value but the first, which is the reference level."""
    return [F.when(col == F.lit(v), 1.0).otherwise(0.0) for v in list(values)[1:]]


# ---- one-pass Gram sums


def gram_sums(blocks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per key in `p`: X'X (k x k), X'y (k), y'y, n."""

    def mapper(block, p):
        x = np.asarray(block["x"]).reshape(-1, k)
        y = np.asarray(block["y"])
        return np.concatenate([(x.T @ x).ravel(), x.T @ y, [y @ y, len(y)]])

    return P.as_frame(P.run(P.step(blocks, [], keys, mapper, lambda p, s: s)), blocks, keys)


def unpack_gram(p: np.ndarray, k: int):
    return p[: k * k].reshape(k, k), p[k * k : k * k + k], p[-2], p[-1]


def _map_state(state: DataFrame, keys: list[str], fields: list[T.StructField], fn) -> DataFrame:
    """Small per-model algebra: fn(p) gives a list of rows, all models of a batch at a time."""
    schema = T.StructType([*P.key_fields(state, keys), *fields])
    names = [f.name for f in fields]

    def apply(batches):
        for pdf in batches:
            rows = []
            for key, block in P.block_rows_of(pdf, keys):
                rows += [(*key, *r) for r in fn(np.asarray(block["p"], dtype=float))]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return state.mapInPandas(apply, schema)


def ols(blocks: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """Ordinary least squares: one row per (keys, term) with `coef`, `sigma2` and `n`.

    The first feature is expected to be the constant.
    """
    k = len(terms)

    def fit(p):
        xx, xy, yy, n = unpack_gram(p, k)
        b = P.solve_spd(xx, xy)
        rss = max(yy - b @ xy, 0.0)
        return [(t, float(c), float(rss / max(n - k, 1)), int(n)) for t, c in zip(terms, b)]

    fields = [
        T.StructField("term", T.StringType()),
        T.StructField("coef", T.DoubleType()),
        T.StructField("sigma2", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
    return _map_state(gram_sums(blocks, keys, k), keys, fields, fit)


def stepwise(blocks: DataFrame, keys: list[str], groups: dict[str, list[int]], k: int) -> DataFrame:
    """Backward selection of whole terms by AIC.

    `groups` maps a term to its feature columns; columns in no group always stay. Every sub-model is
    solved from the one Gram matrix. One row per (keys, step) with the term that was dropped and the AIC after it.
    """
    fixed = [i for i in range(k) if not any(i in g for g in groups.values())]

    def aic_of(p, names):
        xx, xy, yy, n = unpack_gram(p, k)
        idx = fixed + [i for t in names for i in groups[t]]
        sub = xx[np.ix_(idx, idx)]
        rss = max(yy - P.solve_spd(sub, xy[idx]) @ xy[idx], 1e-12)
        d = np.sqrt(np.maximum(np.diag(sub), 1e-300))
        rank = np.linalg.matrix_rank(sub / np.outer(d, d), tol=1e-9, hermitian=True)
        # rounded, so that a collinear term, which changes nothing, is a tie and goes
        return round(float(n * np.log(rss / n) + 2 * rank), 6)

    def select(p):
        names = list(groups)
        best = aic_of(p, names)
        out = [(0, None, best, ",".join(names))]
        while names:
            trial = {t: aic_of(p, [n for n in names if n != t]) for t in names}
            t = min(trial, key=trial.get)
            if trial[t] > best:
                break
            best = trial[t]
            names.remove(t)
            out.append((len(out), t, best, ",".join(names)))
        return out

    fields = [
        T.StructField("step", T.IntegerType()),
        T.StructField("dropped", T.StringType()),
        T.StructField("aic", T.DoubleType()),
        T.StructField("kept", T.StringType()),
    ]
    return _map_state(gram_sums(blocks, keys, k), keys, fields, select)


# ---- quantile regression


def quantile_regression(
    blocks: DataFrame, keys: list[str], k: int, levels=LEVELS, rounds: int = 24, floor: float = 1e-4
) -> DataFrame:
    """Coefficients of a linear quantile regression for all levels at once; the first feature is the constant.

    Majorise-minimise: each pass solves a weighted least-squares problem with weights 1 / (eps + |residual|), where
    eps falls to `floor` times the mean absolute residual of the least-squares fit. Every second solution is
    extrapolated along the last two steps and taken back if the loss rose. Returns keys, `coefs` (array per level in
    order, k each) and `loss` (array, mean pinball per level at the second last coefficients).
    """
    taus = np.asarray(levels)
    m = len(taus)
    start = P.run(P.step(blocks, [], keys, _ols_mapper(k), _ols_reducer(k, taus)))

    # p = [phase, round, scale, then per level: current, base, first, loss of first, loss now]
    width = 3 * k + 2

    def mapper(block, p):
        x = np.asarray(block["x"]).reshape(-1, k)
        y = np.asarray(block["y"])
        out = [[len(y), np.abs(y).sum()], x.sum(axis=0)]
        for j in range(m):
            b = p[3 + j * width :][:k]
            r = y - x @ b
            eps = p[2] * max(0.5 ** (p[1] + 1), floor)
            w = 1.0 / (eps + np.abs(r))
            xw = x * w[:, None]
            out += [(x.T @ xw).ravel(), xw.T @ y, [np.maximum(taus[j] * r, (taus[j] - 1) * r).sum()]]
        return np.concatenate(out)

    def reducer(p, s):
        n, ones = s[0], s[2 : 2 + k]
        q = p.copy()
        phase = int(p[0])
        for j in range(m):
            part = s[2 + k + j * (k * k + k + 1) :][: k * k + k + 1]
            loss = part[-1] / n
            at = 3 + j * width
            now, base, first = p[at : at + k], p[at + k : at + 2 * k], p[at + 2 * k : at + 3 * k]
            new = P.solve_spd(part[: k * k].reshape(k, k), part[k * k : k * k + k] + (2 * taus[j] - 1) * ones)
            if phase == 0:
                if p[1] > 0 and loss > p[at + 3 * k]:
                    # the extrapolated point was worse: go on from the plain step kept in `first`
                    q[at : at + k] = first
                    q[at + k : at + 2 * k] = now
                    q[at + 3 * k + 1] = p[at + 3 * k]
                    continue
                q[at + k : at + 2 * k] = now
                q[at + 2 * k : at + 3 * k] = new
                q[at : at + k] = new
            else:
                step1, step2 = now - base, new - now
                bend = step2 - step1
                size = np.linalg.norm(bend)
                stretch = min(max(np.linalg.norm(step1) / size, 1.0), 8.0) if size > 0 else 1.0
                q[at : at + k] = base + 2 * stretch * step1 + stretch**2 * bend
                q[at + 2 * k : at + 3 * k] = new
                q[at + 3 * k] = loss
            q[at + 3 * k + 1] = loss
        q[0], q[1] = 1 - phase, p[1] + 1
        return q

    fitted = P.iterate(blocks, start, keys, mapper, reducer, rounds)
    pick = lambda off, size: F.flatten(F.array(*[F.slice("p", 4 + j * width + off, size) for j in range(m)]))
    # `first` holds the last plain solution after an extrapolation round
    return fitted.select(*keys, pick(2 * k, k).alias("coefs"), pick(3 * k + 1, 1).alias("loss"))


def _ols_mapper(k):
    def mapper(block, p):
        x = np.asarray(block["x"]).reshape(-1, k)
        y = np.asarray(block["y"])
        return np.concatenate([(x.T @ x).ravel(), x.T @ y, [y @ y, len(y)]])

    return mapper


def _ols_reducer(k, taus):
    def reducer(p, s):
        xx, xy, yy, n = unpack_gram(s, k)
        b = P.solve_spd(xx, xy)
        scale = np.sqrt(max(yy - b @ xy, 0.0) / n) + 1e-9
        out = [[0.0, 0.0, scale]]
        for tau in taus:
            shifted = b.copy()
            shifted[0] += scale * NormalDist().inv_cdf(tau)
            out.append(np.concatenate([shifted, shifted, shifted, [np.inf, np.inf]]))
        return np.concatenate(out)

    return reducer


def predict_levels(df: DataFrame, coefs: DataFrame, keys: list[str], features: list[Column], levels=LEVELS) -> DataFrame:
    """Dot product with the coefficients of every level; adds the array `q` in level order."""
    k = len(features)
    x = F.array(*[f.cast("double") for f in features])
    joined = df.withColumn("_x", x).join(broadcast_if_small(coefs.select(*keys, "coefs")), keys)
    dot = lambda j: F.aggregate(
        F.zip_with("_x", F.slice("coefs", j * k + 1, k), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )
    return joined.withColumn("q", F.array(*[dot(j) for j in range(len(levels))])).drop("_x", "coefs")
