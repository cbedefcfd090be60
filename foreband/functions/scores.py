"""Scoring rules for quantile forecasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinball(y: Column, q: Column, tau: Column) -> Column:
    """Plain pinball score; lower is better."""
    return F.greatest(tau * (y - q), (tau - 1) * (y - q))


def pinball2(y: Column, q: Column, tau: Column) -> Column:
    """Doubled pinball score, at level .5 the absolute error."""
    return pinball(y, q, tau) * 2


def negated_pinball2(y: Column, q: Column, tau: Column) -> Column:
    """Doubled pinball score with the sign turned, so that model selection maximises it.

    Null when the level is not inside (0, 1).
    """
    return F.when((tau > 0) & (tau < 1), -pinball2(y, q, tau))


def covered(y: Column, low: Column, high: Column) -> Column:
    return y.between(low, high).cast("double")
