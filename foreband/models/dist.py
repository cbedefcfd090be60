"""Maximum-likelihood fits of distributions to returns: normal, Cauchy, Student's t."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foreband.models import passes as P
from foreband.models.recursion import Compass


def cauchy_loglik(x: np.ndarray, location: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = (x[:, None] - location) / scale
    return -(np.log(math.pi * scale) + np.log1p(z * z)).sum(axis=0)


def t_loglik(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    const = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * v) for v in df])
    return (const - (df + 1) / 2 * np.log1p((x * x)[:, None] / df)).sum(axis=0)


def fit_distributions(blocks: DataFrame, keys: list[str], rounds: int = 18) -> DataFrame:
    """One row per (keys, distribution): `estimate1`, `estimate2`, `loglik`, `aic`, `bic`, `n`.

    Normal: mean and deviation. Cauchy: location and scale. t: degrees of freedom of the plain t, started at 2.
    The search for the last two shares its passes over the blocks, which hold the sample in `y` with `lead` rows to skip.
    """
    blocks = blocks.select(*keys, "block", "lead", "y")
    cauchy, student = Compass(1, 2, np.array([0.0, 0.0])), Compass(1, 1, np.array([math.log(2.0)]))
    size = cauchy.size

    def sample(block):
        return np.asarray(block["y"])[block["lead"] :]

    def moments(block, p):
        y = sample(block)
        return np.array([len(y), y.sum(), y @ y])

    def start(p, s):
        mean = s[1] / s[0]
        dev = math.sqrt(max(s[2] / s[0] - mean * mean, 1e-300))
        return np.concatenate([[s[0], mean, dev], cauchy.initial(), student.initial()])

    def split(p):
        c, t = cauchy.candidates(p[3 : 3 + size]), student.candidates(p[3 + size :])
        return p[1] + p[2] * c[:, 0], p[2] * np.exp(c[:, 1]), np.exp(t[:, 0])

    def mapper(block, p):
        location, scale, df = split(p)
        y = sample(block)
        return np.concatenate([cauchy_loglik(y, location, scale), t_loglik(y, df)])

    def reducer(p, s):
        k = len(cauchy.moves)
        return np.concatenate([p[:3], cauchy.update(p[3 : 3 + size], s[:k]), student.update(p[3 + size :], s[k:])])

    state = P.run(P.step(blocks, [], keys, moments, start))
    fitted = P.iterate(blocks, state, keys, mapper, reducer, rounds)
    names = ["distribution", "estimate1", "estimate2", "loglik", "aic", "bic", "n"]
    kinds = [T.StringType(), *[T.DoubleType()] * 5, T.LongType()]
    schema = T.StructType([*P.key_fields(blocks, keys), *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def unpack(batches):
        for pdf in batches:
            rows = []
            for key, row in P.block_rows_of(pdf, keys):
                p = np.asarray(row["p"], dtype=float)
                n, mean, dev = p[:3]
                c, t = p[3 : 3 + size], p[3 + size :]
                normal = -n / 2 * (math.log(2 * math.pi * dev * dev) + 1)
                found = [
                    ("normal", mean, dev, normal, 2),
                    ("cauchy", mean + dev * c[0], dev * math.exp(c[1]), c[3], 2),
                    ("t", math.exp(t[0]), None, t[2], 1),
                ]
                for name, first, second, loglik, k in found:
                    rows.append((*key, name, first, second, loglik, 2 * k - 2 * loglik, k * math.log(n) - 2 * loglik, int(n)))
            yield pd.DataFrame(rows, columns=schema.names)

    return fitted.mapInPandas(unpack, schema)
