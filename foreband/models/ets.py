"""Exponential smoothing without a season: form and parameters by AICc, and forecasts.

Three additive-error forms: no trend (N), linear trend (A), damped trend (Ad). The one-step errors of
each obey a linear recursion of depth two, so the block machinery of the volatility models applies.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreband.models import passes as P
from foreband.models import recursion as R
from foreband.operators.ordered import BLOCK_ROWS

FORMS = ("N", "A", "Ad")
# Estimated values per form, with initial states and the variance.
FREE = (3, 5, 6)
SKIP = 2


def trend_blocks(df: DataFrame, keys: list[str], value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of a frame that has `pos`."""
    rows = df.select(*keys, "pos", F.col(value).cast("double").alias("y"))
    return P.run(P.ordered_blocks(rows, keys, ["y"], SKIP, block_rows=block_rows).drop("pos", "n_own"))


def _decode(theta: np.ndarray, form: np.ndarray):
    expit = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    alpha = 1e-4 + (1 - 2e-4) * expit(theta[:, 0])
    beta = np.where(form == 0, 0.0, alpha * expit(theta[:, 1]))
    phi = np.where(form == 0, 0.0, np.where(form == 1, 1.0, 0.8 + 0.18 * expit(theta[:, 2])))
    return alpha, beta, phi


def _recursion(alpha, beta, phi):
    return np.column_stack([1 - alpha + phi - phi * beta, -phi * (1 - alpha)])


def _inputs_for(block, phi):
    """Differences the errors are driven by; the first two rows of a series have none."""
    y, lead = np.asarray(block["y"]), block["lead"]
    d1 = np.diff(y, prepend=y[0])
    d2 = np.concatenate([[0.0], d1[:-1]])
    u = d1[lead:, None] - phi[None] * d2[lead:, None]
    if block["block"] == 0:
        u[:SKIP] = 0.0
    return u


def fit(blocks: DataFrame, keys: list[str], rounds: int = 14) -> DataFrame:
    """Best form per key: keys, form, alpha, beta, phi, aicc, n and the state `p` for `forecast`."""
    forms = np.arange(len(FORMS))
    compass = R.Compass(len(FORMS), 3, np.array([0.0, -2.0, 1.0]))
    each = np.repeat(forms, len(compass.moves))

    def inputs(block, p):
        alpha, beta, phi = _decode(compass.candidates(p[1:]), each)
        return _recursion(alpha, beta, phi), _inputs_for(block, phi)

    def initial(p):
        return np.zeros((len(each), 2))

    def mapper(block, p, e):
        return np.concatenate([[len(e)], (e * e).sum(axis=0)])

    def reducer(p, s):
        n = s[0] - SKIP
        loglik = -n / 2 * np.log(np.maximum(s[1:], 1e-12) / n)
        return np.concatenate([[n], compass.update(p[1:], loglik)])

    start = [0.0, *compass.initial()]
    fitted = R.search(blocks, start, keys, inputs, initial, 2, mapper, reducer, rounds)
    names = ["form", "alpha", "beta", "phi", "aicc"]
    kinds = [T.StringType(), *[T.DoubleType()] * 4]
    schema = T.StructType(
        [*P.key_fields(blocks, keys), *[T.StructField(n, k) for n, k in zip(names, kinds)], T.StructField("n", T.LongType()), P.vector("p")]
    )

    def choose(batches):
        for pdf in batches:
            rows = []
            for key, row in P.block_rows_of(pdf, keys):
                p = np.asarray(row["p"], dtype=float)
                n, s = p[0], p[1:].reshape(len(FORMS), -1)
                alpha, beta, phi = _decode(s[:, :3], forms)
                aicc = [2 * k - 2 * v + 2 * k * (k + 1) / max(n - k - 1, 1) for k, v in zip(FREE, s[:, -1])]
                i = int(np.argmin(aicc))
                values = (float(alpha[i]), float(beta[i]), float(phi[i]))
                rows.append((*key, FORMS[i], *values, float(aicc[i]), int(n) + SKIP, np.array(values)))
            yield pd.DataFrame(rows, columns=schema.names)

    return fitted.mapInPandas(choose, schema)


def given_parameters(blocks: DataFrame, keys: list[str], alpha: float, beta: float, phi: float) -> DataFrame:
    p = F.array(F.lit(float(alpha)), F.lit(float(beta)), F.lit(float(phi)))
    return blocks.select(*keys).distinct().withColumn("p", p)


def _given_inputs(block, p):
    alpha, beta, phi = p[:1], p[1:2], p[2:3]
    return _recursion(alpha, beta, phi), _inputs_for(block, phi)


def _zero(p):
    return np.zeros((1, 2))


def forecast(blocks: DataFrame, fits: DataFrame, keys: list[str], n_ahead: int = 3) -> DataFrame:
    """Forecasts from the level and trend after the last row: keys, step, value."""
    state = P.state_hint(blocks, keys)(fits.select(*keys, "p"))
    ready = R.with_starts(blocks, state, keys, _given_inputs, _zero, 2, R.last_block(blocks)).join(state, keys)
    last = blocks.groupBy(*keys).agg(F.max("block").alias("block"))
    schema = T.StructType([*P.key_fields(blocks, keys), T.StructField("step", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def apply(batches):
        for pdf in batches:
            rows = []
            for key, block in P.block_rows_of(pdf, keys):
                p = np.asarray(block["p"], dtype=float)
                e, s0, _ = R.run_block(block, p, _given_inputs, _zero)
                alpha, beta, phi = p
                e = np.concatenate([s0[0, ::-1], e[:, 0]])
                y = np.asarray(block["y"])
                level = y[-1] - (1 - alpha) * e[-1]
                rise = (y[-1] - y[-2] if len(y) > 1 else 0.0) - e[-1] + (1 - alpha) * e[-2]
                slope = phi * rise + phi * beta * e[-1]
                value = level
                for step in range(1, n_ahead + 1):
                    value += slope * phi ** (step - 1) if phi else 0.0
                    rows.append((*key, step, float(value)))
            yield pd.DataFrame(rows, columns=schema.names)

    return ready.join(last, [*keys, "block"], "left_semi").mapInPandas(apply, schema)


