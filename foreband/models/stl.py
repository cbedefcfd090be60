"""Seasonal-trend decomposition by loess.

Every smoother in the procedure looks at a bounded number of neighbours. A block of the series with enough rows on
both sides therefore decomposes to exactly what the whole series would give, and blocks run side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreband.models import passes as P
from foreband.operators.ordered import BLOCK_ROWS


def next_odd(v: float) -> int:
    n = math.ceil(v)
    return n if n % 2 else n + 1


def spans(period: int, seasonal: int) -> tuple[int, int]:
    """Default trend and low-pass windows."""
    return next_odd(1.5 * period / (1 - 1.5 / seasonal)), next_odd(period)


def loess(v: np.ndarray, window: int, degree: int, at: np.ndarray | None = None) -> np.ndarray:
    """Local constant or linear fit with tricube weights on an even grid; `at` may lie one step outside."""
    n = len(v)
    at = np.arange(n, dtype=float) if at is None else at
    q = min(window, n)
    first = np.clip(np.round(at).astype(int) - q // 2, 0, n - q)
    idx = first[:, None] + np.arange(q)
    dist = np.abs(idx - at[:, None])
    reach = dist.max(axis=1) + (max(window - n, 0) // 2)
    rel = dist / np.maximum(reach, 1e-12)[:, None]
    w = np.where(rel <= 0.001, 1.0, np.where(rel < 0.999, (1 - np.minimum(rel, 1) ** 3) ** 3, 0.0))
    total = w.sum(axis=1)
    near = v[idx]
    mean = (w * near).sum(axis=1) / total
    if degree == 0:
        return mean
    centre = (w * idx).sum(axis=1) / total
    dev = idx - centre[:, None]
    spread = (w * dev * dev).sum(axis=1)
    slope = np.where(spread > 1e-12, (w * dev * near).sum(axis=1) / np.maximum(spread, 1e-12), 0.0)
    return mean + slope * (at - centre)


def moving_average(v: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(v, np.full(k, 1.0 / k), mode="valid")


def decompose(y: np.ndarray, period: int, seasonal: int, trend: int, low: int, degree: int, inner: int):
    """Trend and season of one stretch of the series."""
    n = len(y)
    t = np.zeros(n)
    season = np.zeros(n)
    for _ in range(inner):
        detrended = y - t
        # smoothed cycle-subseries, one more cycle at both ends
        cycle = np.zeros(n + 2 * period)
        for ph in range(min(period, n)):
            sub = detrended[ph::period]
            at = np.arange(-1, len(sub) + 1, dtype=float)
            cycle[ph::period][: len(at)] = loess(sub, seasonal, degree, at)
        smooth = moving_average(moving_average(moving_average(cycle, period), period), 3)
        season = cycle[period : period + n] - loess(smooth, low, 1)
        t = loess(y - season, trend, 1)
    return t, season


def reach(period: int, seasonal: int, trend: int, low: int, inner: int) -> int:
    """How far a value can depend on its neighbours."""
    return inner * (period * (seasonal // 2 + 2) + period + 2 + low // 2 + trend // 2 + 2)


def stl(
    df: DataFrame,
    keys: list[str],
    ts: str,
    value: str,
    period: int = 7,
    seasonal: int = 11,
    degree: int = 0,
    inner: int = 2,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Decomposition of a frame that has `pos`: keys, ts, pos, value, trend, season, remainder."""
    trend, low = spans(period, seasonal)
    halo = reach(period, seasonal, trend, low, inner)
    rows = df.select(*keys, "pos", ts, F.col(value).cast("double").alias("y"))
    blocks = P.ordered_blocks(rows, keys, [ts, "y"], halo, halo, block_rows)
    out = T.StructType(
        [*P.key_fields(blocks, keys), blocks.schema[ts], blocks.schema["pos"], P.vector("value"), P.vector("trend"), P.vector("season")]
    )

    def apply(batches):
        for pdf in batches:
            found = []
            for key, block in P.block_rows_of(pdf, keys):
                y, pos = np.asarray(block["y"]), np.asarray(block["pos"])
                t, s = decompose(y, period, seasonal, trend, low, degree, inner)
                own = slice(block["lead"], block["lead"] + block["n_own"])
                found.append((*key, block[ts][own], pos[own], y[own], t[own], s[own]))
            yield pd.DataFrame(found, columns=out.names)

    packed = P.run(blocks.mapInPandas(apply, out))
    flat = packed.select(*keys, F.inline(F.arrays_zip(ts, "pos", "value", "trend", "season")))
    return flat.withColumn("remainder", F.col("value") - F.col("trend") - F.col("season"))
