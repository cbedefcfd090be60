"""GARCH order search, volatility paths, n-ahead forecasts and their quantiles.

The variance follows sigma2_t = omega + sum alpha_i e_(t-i)^2 + sum beta_j sigma2_(t-j) with every weight free. Orders and parameters are
searched together: one pass evaluates the likelihood and the scores of all orders of all series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreband import LEVELS
from foreband.models import arma as A
from foreband.models import passes as P
from foreband.models import recursion as R

# decoded parameters: omega, nu, alpha (6), beta (6)
ALPHA, BETA = 2, 2 + A.MAX_ORDER
# Alpha and beta together stay below it.
PERSISTENCE = 0.9999


def layout(orders: np.ndarray) -> np.ndarray:
    """Which coordinates each order uses: log omega, degrees of freedom, alpha (6), beta (6)."""
    lag = np.arange(A.MAX_ORDER)
    ones = np.ones((len(orders), 2), bool)
    return np.concatenate([ones, lag < orders[:, :1], lag < orders[:, 1:]], axis=1)


def decode(theta: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, ...]:
    """Coordinates (C, 14) to omega, nu, alpha (C, 6), beta (C, 6). The weights and what they leave to 1 are shares, so they are positive and stationary."""
    w = np.where(used[:, 2:], np.exp(np.clip(theta[:, 2:], -30, 30)), 0.0)
    w = PERSISTENCE * w / (1 + w.sum(axis=1, keepdims=True))
    return np.exp(np.clip(theta[:, 0], -60, 60)), 2.05 + np.exp(np.clip(theta[:, 1], -8, 7)), w[:, : A.MAX_ORDER], w[:, A.MAX_ORDER :]


def encode(omega, nu, alpha, beta) -> np.ndarray:
    """Coordinates of given parameters; a weight of zero becomes a very small one."""
    w = np.maximum(np.concatenate([alpha, beta], axis=-1) / PERSISTENCE, 1e-6)
    rest = np.maximum(1 - w.sum(axis=-1, keepdims=True), 1e-6)
    return np.concatenate([np.log(omega)[..., None], np.log(np.maximum(nu - 2.05, 1e-3))[..., None], np.log(w / rest)], axis=-1)


def first_guess(orders: np.ndarray, var: float) -> np.ndarray:
    lag = np.arange(A.MAX_ORDER)
    alpha, beta = (np.where(lag < orders[:, i : i + 1], total / orders[:, i : i + 1], 0.0) for i, total in ((0, 0.07), (1, 0.85)))
    return encode(np.full(len(orders), 0.08 * var), np.full(len(orders), 8.0), alpha, beta)


def variance_inputs(e: np.ndarray, lead: int, omega, alpha, var: float) -> np.ndarray:
    """omega + sum alpha_i e_(t-i)^2 for the own rows (rows, candidates); squares before the first row count as `var`."""
    sq = np.concatenate([np.full(max(A.MAX_ORDER - lead, 0), var), e * e])
    first = max(lead, A.MAX_ORDER)
    return omega[None, :] + A.lag_matrix(sq, first, A.MAX_ORDER) @ alpha.T


def log_likelihoods(e: np.ndarray, sigma2: np.ndarray, nu: np.ndarray | None) -> np.ndarray:
    """Log-likelihood (rows, candidates); innovations have variance one, Student-t or (nu None) normal."""
    sigma2 = np.maximum(sigma2, 1e-12)
    sq = (e * e)[:, None] / sigma2
    if nu is None:
        return -0.5 * (np.log(2 * np.pi * sigma2) + sq)
    const = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2)) for v in nu], dtype=float)
    return const - 0.5 * np.log(sigma2) - (nu + 1) / 2 * np.log1p(sq / (nu - 2))


def nested_best(orders: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each order the order inside it (itself included) with the highest value; the largest of equal ones."""
    inside = (orders[None, :, :] <= orders[:, None, :]).all(axis=2)
    own = np.eye(len(orders), dtype=bool)
    held = np.where(inside, value[None, :], -np.inf)
    return np.where((held > value[:, None]).any(axis=1), held.argmax(axis=1), own.argmax(axis=1))


def search_orders(
    residuals: DataFrame, keys: list[str], max_p: int, max_q: int, innovations: str = "t", limit: int = 100
) -> DataFrame:
    """Every GARCH order with its likelihood, AIC, BIC and parameters: keys, garch_p, garch_q, loglik, aic, bic, converged, rounds, `g`.

    All parameters are free: omega, degrees of freedom, alpha and beta. All orders of all keys climb together, one pass a step, until
    each has converged or `limit` passes are over (then converged is false). Orders that end below one nested in them climb again from
    there, and at last take over its parameters if those are still better, so the likelihood never falls with the order. `g` is omega,
    degrees of freedom, alpha (6), beta (6). Variances before the first row count as the sample variance.
    """
    residuals = residuals.select(*keys, "block", "lead", "e")
    orders = np.array([(p, q) for p in range(1, max_p + 1) for q in range(1, max_q + 1)])
    student = innovations == "t"
    used = layout(orders)
    used[:, 1] &= student
    climber = R.Climber(used)

    def moments(block, p):
        e = np.asarray(block["e"])[block["lead"] :]
        return np.array([len(e), e @ e])

    def begin(p, s):
        var = max(s[1] / max(s[0], 1), 1e-12)
        return np.concatenate([[s[0], var], climber.at(first_guess(orders, var))])

    def inputs(block, p):
        points, which = climber.candidates(p[2:])
        omega, _, alpha, beta = decode(points, used[which])
        return beta, variance_inputs(np.asarray(block["e"]), block["lead"], omega, alpha, p[1])

    def initial(p):
        return np.full((len(climber.candidates(p[2:])[1]), A.MAX_ORDER), p[1])

    def mapper(block, p, sigma2):
        points, which = climber.candidates(p[2:])
        nu = decode(points, used[which])[1]
        return climber.scores(p[2:], log_likelihoods(np.asarray(block["e"])[block["lead"] :], sigma2, nu if student else None))

    def reducer(p, s):
        return np.concatenate([p[:2], climber.update(p[2:], s)])

    def again(p):
        """Starts orders anew that one nested in them beats."""
        p = p.copy()
        v = climber.view(p[2:])
        best = nested_best(orders, v["best"])
        held = encode(*(x[best] for x in decode(v["centre"], used)))
        for i in np.flatnonzero(best != np.arange(len(orders))):
            fresh = climber.view(climber.at(np.tile(held[i], (len(orders), 1))))
            for name in ("centre", "trial", "best", "damp", "done", "g", "h"):
                v[name][i] = fresh[name][i]
        return p

    done = lambda p: climber.finished(p[2:])
    climb = lambda state: R.climb(residuals, state, keys, inputs, initial, A.MAX_ORDER, mapper, reducer, done, limit)
    state = climb(P.run(P.step(residuals, [], keys, moments, begin)))
    if len(orders) > 1:
        state = climb(P.changed(state, again))
    fitted = P.as_frame(state, residuals, keys)
    names = ["garch_p", "garch_q", "loglik", "aic", "bic", "converged", "rounds"]
    kinds = [T.IntegerType(), T.IntegerType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.BooleanType(), T.IntegerType()]
    schema = T.StructType([*P.key_fields(residuals, keys), *[T.StructField(n, k) for n, k in zip(names, kinds)], P.vector("g")])

    def unpack(batches):
        for pdf in batches:
            rows = []
            for key, row in P.block_rows_of(pdf, keys):
                p = np.asarray(row["p"], dtype=float)
                v = climber.view(p[2:])
                omega, nu, alpha, beta = decode(v["centre"], used)
                best = nested_best(orders, v["best"])
                for i, (po, qo) in enumerate(orders):
                    j = best[i]
                    loglik, free = float(v["best"][j]), po + qo + (2 if student else 1)
                    g = np.concatenate([[omega[j], nu[j] if student else np.inf], alpha[j], beta[j]])
                    criteria = (2 * free - 2 * loglik, free * math.log(p[0]) - 2 * loglik)
                    rows.append((*key, int(po), int(qo), loglik, *map(float, criteria), bool(v["done"][i]), int(v["rounds"][i]), g))
            yield pd.DataFrame(rows, columns=schema.names)

    return fitted.mapInPandas(unpack, schema)


def given_parameters(residuals: DataFrame, keys: list[str], omega: float, alpha: list[float], beta: list[float], nu: float) -> DataFrame:
    """The same parameters for every key, as a frame of fits."""
    pad = lambda v: [*v, *[0.0] * (A.MAX_ORDER - len(v))]
    g = [omega, nu, *pad(alpha), *pad(beta)]
    return residuals.select(*keys).distinct().withColumn("g", F.array(*[F.lit(float(v)) for v in g]))


def _long_run(g: np.ndarray) -> float:
    return g[0] / max(1 - g[ALPHA:].sum(), 1e-6)


def _sigma_inputs(block: dict, g: np.ndarray):
    u = variance_inputs(np.asarray(block["e"]), block["lead"], g[:1], g[None, ALPHA:BETA], _long_run(g))
    return g[None, BETA:], u


def _sigma_start(g: np.ndarray) -> np.ndarray:
    return np.full((1, A.MAX_ORDER), _long_run(g))


def with_variance_starts(residuals: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    state = P.state_hint(residuals, keys)(fits.select(*keys, F.col("g").alias("p")))
    ready = R.with_starts(residuals, state, keys, _sigma_inputs, _sigma_start, A.MAX_ORDER, R.last_block(residuals))
    return ready.join(state, keys)


def paths(residuals: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """In-sample path: keys, date, y, fitted, sigma."""
    out = T.StructType([*P.key_fields(residuals, keys), residuals.schema["day"], P.vector("y"), P.vector("fitted"), P.vector("sigma")])

    def apply(batches):
        for pdf in batches:
            rows = []
            for key, block in P.block_rows_of(pdf, keys):
                sigma2, _, _ = R.run_block(block, np.asarray(block["p"], dtype=float), _sigma_inputs, _sigma_start)
                y, e = np.asarray(block["y"]), np.asarray(block["e"])[block["lead"] :]
                rows.append((*key, block["day"], y, y - e, np.sqrt(sigma2[:, 0])))
            yield pd.DataFrame(rows, columns=out.names)

    packed = with_variance_starts(residuals, fits, keys).mapInPandas(apply, out)
    flat = packed.select(*keys, F.inline(F.arrays_zip("day", "y", "fitted", "sigma")))
    return flat.select(*keys, F.date_from_unix_date("day").alias("date"), "y", "fitted", "sigma")


def forecast(residuals: DataFrame, fits: DataFrame, keys: list[str], n_ahead: int = 5) -> DataFrame:
    """Mean and deviation for the steps after the last row: keys, step, mean, sigma, shape (infinite for normal).

    Only the last block of a series is needed: future squares and variances have the same expectation.
    """
    residuals = residuals.drop("day")
    last = residuals.groupBy(*keys).agg(F.max("block").alias("block"))
    ready = with_variance_starts(residuals, fits, keys).join(last, [*keys, "block"], "left_semi")
    schema = T.StructType(
        [
            *P.key_fields(residuals, keys),
            T.StructField("step", T.IntegerType()),
            T.StructField("mean", T.DoubleType()),
            T.StructField("sigma", T.DoubleType()),
            T.StructField("shape", T.DoubleType()),
        ]
    )
    d = A.MAX_ORDER

    def apply(batches):
        for pdf in batches:
            rows = []
            for key, block in P.block_rows_of(pdf, keys):
                g, m = np.asarray(block["p"], dtype=float), np.asarray(block["mean_p"], dtype=float)
                sigma2, s0, _ = R.run_block(block, g, _sigma_inputs, _sigma_start)
                e = np.concatenate([np.zeros(d), np.asarray(block["e"])])[-d:]
                h2 = np.concatenate([s0[0, ::-1], sigma2[:, 0]])[-d:]
                n_seen = min(d, len(np.asarray(block["e"])))
                e2 = np.where(np.arange(d) < d - n_seen, _long_run(g), e * e)
                y = np.asarray(block["y_last"], dtype=float)
                for step in range(1, n_ahead + 1):
                    mean = m[3] + m[A.PHI : A.PHI + d] @ y[::-1][:d] + m[A.THETA : A.THETA + d] @ e[::-1][:d]
                    var = g[0] + g[ALPHA:BETA] @ e2[::-1][:d] + g[BETA:] @ h2[::-1][:d]
                    rows.append((*key, step, float(mean), float(np.sqrt(var)), float(g[1])))
                    y, e = np.append(y, mean)[-d:], np.append(e, 0.0)[-d:]
                    e2, h2 = np.append(e2, var)[-d:], np.append(h2, var)[-d:]
            yield pd.DataFrame(rows, columns=schema.names)

    return ready.mapInPandas(apply, schema)


# ---- Student-t quantiles


def t_quantile(df: float, taus) -> np.ndarray:
    """Quantiles of Student's t from its density in the angle x = sqrt(df) tan(a)."""
    taus = np.asarray(taus, dtype=float)
    if not np.isfinite(df):
        from statistics import NormalDist

        return np.array([NormalDist().inv_cdf(t) for t in taus])
    half = np.linspace(0.0, np.pi / 2, 20001)
    f = np.cos(half) ** (df - 1)
    step = half[1]
    # Simpson's rule on pairs of cells
    area = np.concatenate([[0.0], np.cumsum((f[:-2:2] + 4 * f[1::2] + f[2::2]) * step / 3)])
    upper = 0.5 * area / area[-1]
    angle = np.interp(np.abs(taus - 0.5), upper, half[::2])
    return np.sign(taus - 0.5) * np.sqrt(df) * np.tan(angle)


def t_quantiles(df: Column, levels=LEVELS, standardized: bool = False) -> Column:
    """Array of t quantiles per row; `standardized` scales them to variance one."""

    @F.pandas_udf("array<double>")
    def quantiles(s: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for v in s:
            v = float(v) if v is not None else math.inf
            if v not in known:
                scale = math.sqrt((v - 2) / v) if standardized and math.isfinite(v) and v > 2 else 1.0
                known[v] = t_quantile(v, levels) * scale
            out.append(known[v])
        return pd.Series(out)

    return quantiles(df)


def quantile_forecasts(steps: DataFrame, levels=LEVELS, standardized: bool = False) -> DataFrame:
    """Adds `q`, mean + sigma times the t quantile, per level in order."""
    z = steps.withColumn("_z", t_quantiles(F.col("shape"), levels, standardized))
    return z.withColumn("q", F.transform("_z", lambda v: F.col("mean") + F.col("sigma") * v)).drop("_z")


def diagonal(forecasts: DataFrame, h: str = "h") -> DataFrame:
    """For the day h steps ahead take the h-step model's h-th step."""
    return forecasts.filter(F.col("step") == F.col(h))
