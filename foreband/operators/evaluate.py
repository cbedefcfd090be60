"""Score summaries: means, coverage, leaderboards, distribution summaries.

Score frames are long: (model, series_id, origin, ts, horizon, tau, y, q, qs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreband import LEVELS
from foreband.functions.numbers import level_name, row_mean, row_sum
from foreband.functions.scores import covered, pinball2
from foreband.operators.frames import levels_to_columns

CASE = ["model", "series_id", "origin", "ts", "horizon"]


def score(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("qs", pinball2(F.col("y"), F.col("q"), F.col("tau")))


def wide_scores(scores: DataFrame, ids: list[str] = CASE, levels=LEVELS) -> DataFrame:
    """One row per forecast case: the score of every level, `mean_qs` and `sum_qs` over the levels."""
    wide = levels_to_columns(scores, ids, "qs", levels, "qs")
    cols = [F.col(level_name("qs", t)) for t in levels]
    return wide.withColumns({"mean_qs": row_mean(*cols), "sum_qs": row_sum(*cols)})


def wide_cases(scores: DataFrame, ids: list[str] = CASE, levels=LEVELS) -> DataFrame:
    """Actual, quantiles and scores of every case in one aggregate."""
    at = lambda t, c: F.max(F.when(F.col("tau") == F.lit(t), F.col(c)))
    cells = [at(t, c).alias(level_name(p, t)) for c, p in (("q", "q"), ("qs", "qs")) for t in levels]
    wide = scores.groupBy(*ids).agg(F.max("y").alias("y"), *cells)
    cols = [F.col(level_name("qs", t)) for t in levels]
    return wide.withColumns({"mean_qs": row_mean(*cols), "sum_qs": row_sum(*cols)})


def evaluation(cases: DataFrame, by: list[str], levels=LEVELS) -> DataFrame:
    """Mean scores and both coverages per group, from one pass over `wide_cases`."""
    inner = covered(F.col("y"), F.col("q0_25"), F.col("q0_75"))
    outer = covered(F.col("y"), F.col("q0_025"), F.col("q0_975"))
    means = [F.avg(c).alias(c) for c in score_columns(levels)]
    return cases.groupBy(*by).agg(*means, F.avg(inner).alias("coverage_50"), F.avg(outer).alias("coverage_95"))


def score_columns(levels=LEVELS) -> list[str]:
    return [*[level_name("qs", t) for t in levels], "mean_qs", "sum_qs"]


def column_means(wide: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return wide.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def means_with_overall(wide: DataFrame, by: list[str], extra: str, cols: list[str]) -> DataFrame:
    """Means per (by, extra) and per by alone in one pass; `extra` is null in the overall rows."""
    sets = [[F.col(c) for c in (*by, extra)], [F.col(c) for c in by]]
    keys = [F.col(c) for c in (*by, extra)]
    return wide.groupingSets(sets, *keys).agg(*[F.avg(c).alias(c) for c in cols])


def leaderboard(wide: DataFrame, by: list[str] = ["model"], score_col: str = "sum_qs") -> DataFrame:
    """Mean over horizons of the mean score, so each horizon weighs the same."""
    per_horizon = wide.groupBy(*by, "horizon").agg(F.avg(score_col).alias("_s"))
    return per_horizon.groupBy(*by).agg(F.avg("_s").alias("score"))


def interval_coverage(wide_q: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Share of actuals inside the central 50 % and 95 % intervals."""
    inner = covered(F.col(y), F.col("q0_25"), F.col("q0_75"))
    outer = covered(F.col(y), F.col("q0_025"), F.col("q0_975"))
    return wide_q.groupBy(*by).agg(F.avg(inner).alias("coverage_50"), F.avg(outer).alias("coverage_95"))


def five_numbers(df: DataFrame, by: list, value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    names = ["minimum", "lower", "median", "upper", "maximum"]
    summary = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("_p"), F.count(value).alias("n"))
    group_cols = [c for c in summary.columns if c not in ("_p", "n")]
    return summary.select(*group_cols, "n", *[F.element_at("_p", i + 1).alias(n) for i, n in enumerate(names)])


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; values outside the range fall in bins 0 and `bins` + 1."""
    bin_no = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fold_summary(fold_scores: DataFrame, by: list[str], score_col: str = "score", within: list[str] = []) -> DataFrame:
    """Mean and deviation over folds, and the rank of the mean (higher is better)."""
    summary = fold_scores.groupBy(*within, *by).agg(
        F.avg(score_col).alias("mean_score"), F.stddev_pop(score_col).alias("std_score"), F.count(score_col).alias("folds")
    )
    return with_rank(summary, "mean_score", within)


def with_rank(df: DataFrame, by_score: str, within: list[str]) -> DataFrame:
    """Competition rank of candidates; a candidate list is a parameter grid, so a handful of rows per key."""
    w = Window.partitionBy(*within).orderBy(F.col(by_score).desc())
    return df.withColumn("rank", F.rank().over(w))


def matrix_score(scored: DataFrame, by: list[str], ids: list[str] = CASE, qs: Column | None = None) -> DataFrame:
    """Mean over cases of the plain pinball score summed over levels."""
    per_case = scored.groupBy(*ids).agg(F.sum(qs if qs is not None else F.col("qs")).alias("_s"))
    return per_case.groupBy(*by).agg(F.avg("_s").alias("matrix_score"))
