"""ARMA order search and estimation from two Gram passes, and the ARMA filter.

Long autoregression first, then a regression on lagged values and lagged residuals of that first step
(Hannan and Rissanen). All orders are sub-models of one Gram matrix, so the search needs no further pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreband.models import passes as P
from foreband.models import recursion as R
from foreband.operators.ordered import BLOCK_ROWS, with_position

LONG = 12
MAX_ORDER = 6
HALO = LONG + MAX_ORDER
# state: p, q, bic, const, phi (6), theta (6), sigma2, n, mean of y
PHI, THETA, SIGMA2, SIZE = 4, 4 + MAX_ORDER, 4 + 2 * MAX_ORDER, 7 + 2 * MAX_ORDER


def return_blocks(returns: DataFrame, keys: list[str], steps, origins: list | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the returns `ret1`, `ret2`, ... per (keys, h [, origin]); an origin sees only its past.

    `day` counts days since 1970: numbers reach Python as one buffer, dates as objects.
    """
    names = [f"ret{h}" for h in steps]
    long = returns.select(*keys, "date", *names).unpivot([*keys, "date"], names, "_h", "y").filter("y IS NOT NULL")
    long = long.select(*keys, F.substring("_h", 4, 2).cast("int").alias("h"), F.unix_date("date").alias("day"), "date", "y")
    placed = with_position(long, [*keys, "h"], "date").drop("n_rows")
    blocks = P.ordered_blocks(placed, [*keys, "h"], ["day", "y"], HALO, block_rows=block_rows)
    if origins is None:
        return P.run(blocks)
    known = F.array(*[F.lit(o) for o in origins])
    per_origin = blocks.withColumn("origin", F.explode(known))
    size = F.size(F.filter("day", lambda d: d <= F.unix_date("origin")))
    kept = per_origin.withColumn("_n", size).withColumn("n_own", F.col("_n") - F.col("lead")).filter("n_own > 0")
    kept = kept.withColumns({c: F.slice(c, F.lit(1), F.col("_n")) for c in ("pos", "day", "y")}).drop("_n")
    return P.run(P.spread(kept, [*keys, "h", "origin"]))


def lag_matrix(v: np.ndarray, first: int, depth: int) -> np.ndarray:
    """Rows v[t-1], ..., v[t-depth] for t from `first` on."""
    return np.column_stack([v[first - k : len(v) - k] for k in range(1, depth + 1)])


def _gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([(x.T @ x).ravel(), x.T @ y, [y @ y, len(y)]])


def _long_regressors(y: np.ndarray, first: int) -> np.ndarray:
    return np.column_stack([np.ones(len(y) - first), lag_matrix(y, first, LONG)])


def _long_mapper(block, p):
    y = np.asarray(block["y"])
    first = max(block["lead"], LONG)
    k = LONG + 1
    if len(y) <= first:
        return np.zeros(k * k + k + 2)
    return _gram(_long_regressors(y, first), y[first:])


def _long_reducer(p, s):
    k = LONG + 1
    return P.solve_spd(s[: k * k].reshape(k, k), s[k * k : k * k + k])


def _lagged_mapper(block, p):
    y = np.asarray(block["y"])
    k = 1 + 2 * MAX_ORDER
    first = max(block["lead"], HALO)
    if len(y) <= first:
        return np.zeros(k * k + k + 2)
    shock = np.concatenate([np.zeros(LONG), y[LONG:] - _long_regressors(y, LONG) @ p])
    x = np.column_stack([np.ones(len(y) - first), lag_matrix(y, first, MAX_ORDER), lag_matrix(shock, first, MAX_ORDER)])
    return _gram(x, y[first:])


def orders(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The Gram sums every order is solved from: keys, `p`."""
    blocks = blocks.select(*keys, "block", "lead", "y")
    long = P.run(P.step(blocks, [], keys, _long_mapper, _long_reducer))
    grams = P.run(P.step(blocks, P.state_hint(blocks, keys)(long), keys, _lagged_mapper, lambda p, s: s))
    return P.as_frame(grams, blocks, keys)


def solve_order(gram: np.ndarray, p: int, q: int) -> np.ndarray:
    """Estimate of one order from the Gram sums, as the state vector of this module."""
    k = 1 + 2 * MAX_ORDER
    xx, xy, yy, n = gram[: k * k].reshape(k, k), gram[k * k : k * k + k], gram[-2], gram[-1]
    idx = [0, *range(1, 1 + p), *range(1 + MAX_ORDER, 1 + MAX_ORDER + q)]
    b = P.solve_spd(xx[np.ix_(idx, idx)], xy[idx])
    sigma2 = max(yy - b @ xy[idx], 1e-12) / n
    out = np.zeros(SIZE)
    out[:3] = p, q, n * np.log(sigma2) + (p + q + 2) * np.log(n)
    out[PHI : PHI + p] = stable(b[1 : 1 + p])
    out[THETA : THETA + q] = -stable(-b[1 + p :])
    out[3] = xy[0] / n * (1 - out[PHI : PHI + p].sum())
    out[SIGMA2 : SIGMA2 + 3] = sigma2, n, xy[0] / n
    return out


def stable(a: np.ndarray, limit: float = 0.98) -> np.ndarray:
    """Shrinks recursion coefficients so that the recursion forgets its start."""
    if len(a) == 0:
        return a
    radius = np.abs(np.linalg.eigvals(R.transition(a[None], 1)[0])).max()
    return a if radius <= limit else a * (limit / radius) ** np.arange(1, len(a) + 1)


ORDER_FIELDS = [
    T.StructField("p_order", T.IntegerType()),
    T.StructField("q_order", T.IntegerType()),
    T.StructField("bic", T.DoubleType()),
    P.vector("p"),
]


def fit_orders(grams: DataFrame, keys: list[str], ps, qs) -> DataFrame:
    """All orders with their BIC and parameters; a grid of at most 36 rows per key."""
    combos = [(p, q) for p in ps for q in qs]
    schema = T.StructType([*P.key_fields(grams, keys), *ORDER_FIELDS])

    def apply(batches):
        for pdf in batches:
            rows = []
            for key, row in P.block_rows_of(pdf, keys):
                gram = np.asarray(row["p"], dtype=float)
                for p, q in combos:
                    fit = solve_order(gram, p, q)
                    rows.append((*key, p, q, float(fit[2]), fit))
            yield pd.DataFrame(rows, columns=schema.names)

    return grams.mapInPandas(apply, schema)


def arma_inputs(block: dict, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residual recursion e_t = (y_t - const - phi y) - theta e; values before the first one count as the mean."""
    y = np.asarray(block["y"])
    lead = block["lead"]
    padded = np.concatenate([np.full(max(MAX_ORDER - lead, 0), p[SIGMA2 + 2]), y])
    first = max(lead, MAX_ORDER)
    fit = p[3] + lag_matrix(padded, first, MAX_ORDER) @ p[PHI : PHI + MAX_ORDER]
    return -p[None, THETA : THETA + MAX_ORDER], (padded[first:] - fit)[:, None]


def zero_start(p: np.ndarray) -> np.ndarray:
    return np.zeros((1, MAX_ORDER))


def residual_blocks(blocks: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with the residuals `e` of the ARMA filter, next to `y`; `e` starts with the last values before the block."""
    state = P.state_hint(blocks, keys)(fits.select(*keys, "p"))
    blocks = blocks.select(*keys, "block", "lead", "day", "y")
    ready = R.with_starts(blocks, state, keys, arma_inputs, zero_start, MAX_ORDER, R.last_block(blocks))
    keep = [blocks.schema[c] for c in ("block", "day")]
    schema = T.StructType(
        [*P.key_fields(blocks, keys), *keep, T.StructField("lead", T.IntegerType()), P.vector("y"), P.vector("e"), P.vector("y_last"), P.vector("mean_p")]
    )

    def apply(batches):
        for pdf in batches:
            rows = []
            for key, block in P.block_rows_of(pdf, keys):
                p = np.asarray(block["p"], dtype=float)
                values, s0, _ = R.run_block(block, p, arma_inputs, zero_start)
                lead, y = block["lead"], np.asarray(block["y"])
                before = s0[0, ::-1] if block["block"] > 0 else np.zeros(0)
                own = [block[f.name] if f.name == "block" else block[f.name][lead:] for f in keep]
                tail = np.concatenate([np.full(MAX_ORDER, p[SIGMA2 + 2]), y])[-MAX_ORDER:]
                rows.append((*key, *own, len(before), y[lead:], np.concatenate([before, values[:, 0]]), tail, p))
            yield pd.DataFrame(rows, columns=schema.names)

    return ready.join(state, keys).mapInPandas(apply, schema)


def given_parameters(blocks: DataFrame, keys: list[str], const: float, phi: float, theta: float) -> DataFrame:
    """The same first-order mean model for every key; values before the first row count as the series' mean."""
    mean = blocks.groupBy(*keys).agg(
        F.sum(F.aggregate(F.slice("y", F.col("lead") + 1, F.col("n_own")), F.lit(0.0), lambda a, v: a + v)).alias("_s"),
        F.sum("n_own").alias("_n"),
    )
    zeros = [F.lit(0.0)] * (MAX_ORDER - 1)
    p = F.array(
        F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(const), F.lit(phi), *zeros, F.lit(theta), *zeros, F.lit(1.0),
        F.col("_n").cast("double"), F.col("_s") / F.col("_n"),
    )
    return mean.select(*keys, p.alias("p"))
