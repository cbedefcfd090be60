"""Queries over forecasts and scores of the seasonal baselines."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from foreband import LEVELS
from foreband.core import checkpoint_dir
from foreband.functions import dates as D
from foreband.functions.numbers import level_name
from foreband.functions.scores import negated_pinball2, pinball
from foreband.operators import evaluate as E
from foreband.operators import frames as R
from foreband.operators.ordered import best_by
from foreband.plans import catalog as C
from foreband.plans.baseline import baseline
from foreband.plans.catalog import query, with_
from foreband.sources.landed import read_forecasts
from foreband.sources.sinks import write_forecasts
from foreband.sources.series import hourly_load

CASE = E.CASE
Q = [level_name("q", t) for t in LEVELS]
SCORES = E.score_columns()
ROUND_SCORES = ", ".join(f"round({c} + 1e-11, 8) AS {c}" for c in SCORES)
MEAN_SCORES = ", ".join(f"round(avg({c}) + 1e-11, 8) AS {c}" for c in SCORES)



def r8(c, name: str | None = None):
    """Rounded to eight decimals, ties upwards: a mean may lie on a tie, where the order of the sum would decide."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-11, 8).alias(name or c)


def wide(spark, root):
    return E.wide_scores(E.score(baseline(spark, root)))


def wide_forecasts(spark, root):
    return R.levels_to_columns(baseline(spark, root), [*CASE, "y"])


@query(
    "j4_forecast_actual",
    with_(C.FORECASTS)
    + """SELECT a.series_id, a.ts, f.model, f.origin, f.horizon, round(a.value + 1e-11, 8) AS y, round(f.q0_5 + 1e-11, 8) AS q0_5
FROM load_h a LEFT JOIN wide_q f ON a.series_id = f.series_id AND a.ts = f.ts""",
)
def j4(spark, root):
    fc = wide_forecasts(spark, root).drop("y")
    out = R.forecasts_with_actuals(hourly_load(spark, root), fc, ["series_id", "ts"])
    return out.select("series_id", "ts", "model", "origin", "horizon", r8("value", "y"), r8("q0_5"))


@query(
    "j5_model_compare",
    with_(C.FORECASTS)
    + """, m AS (SELECT model, series_id, origin, avg(mean_qs) AS s FROM wide GROUP BY 1, 2, 3)
SELECT a.series_id, a.origin, round(a.s + 1e-11, 8) AS mean_qs_lag7, round(b.s + 1e-11, 8) AS mean_qs_lag14
FROM (SELECT * FROM m WHERE model = 'lag7') a LEFT JOIN (SELECT * FROM m WHERE model = 'lag14') b
  ON a.series_id = b.series_id AND a.origin = b.origin""",
)
def j5(spark, root):
    means = E.column_means(wide(spark, root), ["model", "series_id", "origin"], ["mean_qs"])
    of = lambda m: means.filter(F.col("model") == m).select("series_id", "origin", r8("mean_qs", f"mean_qs_{m}"))
    return R.compare_models(of("lag7"), of("lag14"), ["series_id", "origin"])


@query("q1_pinball2", with_(C.FORECASTS) + "SELECT model, series_id, origin, ts, tau, round(y + 1e-11, 8) AS y, round(q + 1e-11, 8) AS q, round(qs + 1e-11, 8) AS qs FROM sc")
def q1(spark, root):
    return E.score(baseline(spark, root)).select("model", "series_id", "origin", "ts", "tau", r8("y"), r8("q"), r8("qs"))


@query(
    "q2_pinball",
    with_(C.FORECASTS) + "SELECT model, series_id, tau, round(avg(qs / 2) + 1e-11, 8) AS mean_pinball, count(*) AS n FROM sc GROUP BY 1, 2, 3",
)
def q2(spark, root):
    plain = pinball(F.col("y"), F.col("q"), F.col("tau"))
    return baseline(spark, root).groupBy("model", "series_id", "tau").agg(
        r8(F.avg(plain), "mean_pinball"), F.count(F.lit(1)).alias("n")
    )


@query(
    "q3_matrix_score",
    with_(C.FORECASTS) + "SELECT model, series_id, origin, round(avg(sum_qs / 2) + 1e-11, 8) AS matrix_score FROM wide GROUP BY 1, 2, 3",
)
def q3(spark, root):
    plain = pinball(F.col("y"), F.col("q"), F.col("tau"))
    out = E.matrix_score(baseline(spark, root), ["model", "series_id", "origin"], qs=plain)
    return out.select("model", "series_id", "origin", r8("matrix_score"))


@query(
    "q4_neg_score",
    with_(C.FORECASTS) + "SELECT model, tau, round(-avg(qs) + 1e-11, 8) AS score FROM sc GROUP BY 1, 2",
)
def q4(spark, root):
    neg = negated_pinball2(F.col("y"), F.col("q"), F.col("tau"))
    return baseline(spark, root).groupBy("model", "tau").agg(r8(F.avg(neg), "score"))


@query("q5_row_scores", with_(C.FORECASTS) + f"SELECT model, series_id, origin, ts, horizon, {ROUND_SCORES} FROM wide")
def q5(spark, root):
    return wide(spark, root).select(*CASE, *[r8(c) for c in SCORES])


@query("a4_score_means", with_(C.FORECASTS) + f"SELECT model, {MEAN_SCORES} FROM wide GROUP BY 1")
def a4(spark, root):
    return E.column_means(wide(spark, root), ["model"], SCORES).select("model", *[r8(c) for c in SCORES])


@query("a5_horizon_means", with_(C.FORECASTS) + f"SELECT model, horizon, {MEAN_SCORES} FROM wide GROUP BY 1, 2")
def a5(spark, root):
    return E.column_means(wide(spark, root), ["model", "horizon"], SCORES).select("model", "horizon", *[r8(c) for c in SCORES])


@query(
    "a6_score_sets",
    with_(C.FORECASTS) + f"SELECT model, horizon, {MEAN_SCORES} FROM wide GROUP BY GROUPING SETS ((model, horizon), (model))",
)
def a6(spark, root):
    return E.means_with_overall(wide(spark, root), ["model"], "horizon", SCORES).select("model", "horizon", *[r8(c) for c in SCORES])


@query("a7_origin_means", with_(C.FORECASTS) + "SELECT model, origin, round(avg(mean_qs) + 1e-11, 8) AS mean_qs FROM wide GROUP BY 1, 2")
def a7(spark, root):
    return E.column_means(wide(spark, root), ["model", "origin"], ["mean_qs"]).select("model", "origin", r8("mean_qs"))


@query(
    "a8_leaderboard",
    with_(C.FORECASTS)
    + "SELECT model, round(avg(s) + 1e-11, 8) AS score FROM (SELECT model, horizon, avg(sum_qs) AS s FROM wide GROUP BY 1, 2) GROUP BY 1",
)
def a8(spark, root):
    return E.leaderboard(wide(spark, root)).select("model", r8("score"))


COVERAGE_SQL = """round(avg(CASE WHEN y BETWEEN q0_25 AND q0_75 THEN 1.0::DOUBLE ELSE 0 END) + 1e-11, 8) AS coverage_50,
  round(avg(CASE WHEN y BETWEEN q0_025 AND q0_975 THEN 1.0::DOUBLE ELSE 0 END) + 1e-11, 8) AS coverage_95"""


@query("a9_coverage", with_(C.FORECASTS) + f"SELECT model, series_id, {COVERAGE_SQL} FROM wide_q GROUP BY 1, 2")
def a9(spark, root):
    cov = E.interval_coverage(wide_forecasts(spark, root), ["model", "series_id"])
    return cov.select("model", "series_id", r8("coverage_50"), r8("coverage_95"))


@query(
    "a10_eval_matrix",
    with_(C.FORECASTS)
    + f""", ev AS (SELECT * FROM (SELECT model, {MEAN_SCORES} FROM wide GROUP BY 1) JOIN (SELECT model, {COVERAGE_SQL} FROM wide_q GROUP BY 1) USING (model)),
long AS (UNPIVOT ev ON COLUMNS(* EXCLUDE (model)) INTO NAME metric VALUE v)
SELECT metric, max(CASE WHEN model = 'lag7' THEN v END) AS lag7, max(CASE WHEN model = 'lag14' THEN v END) AS lag14 FROM long GROUP BY 1""",
)
def a10(spark, root):
    table = E.evaluation(E.wide_cases(E.score(baseline(spark, root))), ["model"])
    metrics = [*SCORES, "coverage_50", "coverage_95"]
    return R.flip(table.select("model", *[r8(c) for c in metrics]), "model", ["lag7", "lag14"], metrics)


@query(
    "u3_transpose_scores",
    with_(C.FORECASTS)
    + f""", ev AS (SELECT model, {MEAN_SCORES} FROM wide GROUP BY 1), long AS (UNPIVOT ev ON COLUMNS(* EXCLUDE (model)) INTO NAME metric VALUE v)
SELECT metric AS "key", max(CASE WHEN model = 'lag14' THEN v END) AS lag14, max(CASE WHEN model = 'lag7' THEN v END) AS lag7 FROM long GROUP BY 1""",
)
def u3(spark, root):
    means = E.column_means(wide(spark, root), ["model"], SCORES)
    return means.select("model", *[r8(c) for c in SCORES]).transpose(F.col("model"))


@query(
    "u4_unpivot",
    with_(C.FORECASTS)
    + """, sel AS (SELECT series_id, ts, y AS demand, q0_025, q0_975 FROM wide_q WHERE model = 'lag7'),
long AS (UNPIVOT sel ON demand, q0_025, q0_975 INTO NAME legend VALUE v) SELECT series_id, ts, legend, round(v + 1e-11, 8) AS value FROM long""",
)
def u4(spark, root):
    sel = wide_forecasts(spark, root).filter("model = 'lag7'").withColumnRenamed("y", "demand")
    return sel.unpivot(["series_id", "ts"], ["demand", "q0_025", "q0_975"], "legend", "v").select("series_id", "ts", "legend", r8("v", "value"))


@query(
    "u5_pivot",
    with_(C.FORECASTS)
    + """SELECT strftime(origin, '%Y%m%d') AS forecast_date, 'energy' AS target, model, series_id, CAST(horizon AS VARCHAR) || ' hour' AS horizon, """
    + ", ".join(f"round({c} + 1e-11, 8) AS {c}" for c in Q)
    + " FROM wide_q WHERE isodow(ts) IN (5, 6) AND hour(ts) IN (12, 16, 20)",
)
def u5(spark, root):
    return submission(baseline(spark, root), "energy").select(
        "forecast_date", "target", "model", "series_id", "horizon", *[r8(c) for c in Q]
    )


def submission(forecasts, target: str):
    """Wide submission rows of the target hours."""
    hit = forecasts.filter(D.in_target_hours(F.col("ts")))
    table = R.levels_to_columns(hit, ["model", "series_id", "origin", "ts", "horizon"])
    return table.select(
        D.compact_date(F.col("origin")).alias("forecast_date"),
        F.lit(target).alias("target"),
        "model",
        "series_id",
        D.horizon_label(F.col("horizon"), "hour").alias("horizon"),
        *Q,
    )


@query(
    "u6_monotone_levels",
    with_(C.FORECASTS)
    + """, packed AS (SELECT model, series_id, origin, ts, list_sort(list(q)) AS qs FROM fc GROUP BY 1, 2, 3, 4)
SELECT model, series_id, origin, ts, """
    + ", ".join(f"round(qs[{i + 1}] + 1e-11, 8) AS {c}" for i, c in enumerate(Q))
    + " FROM packed",
)
def u6(spark, root):
    keys = ["model", "series_id", "origin", "ts"]
    packed = R.monotone(baseline(spark, root).groupBy(*keys).agg(F.collect_list("q").alias("qs")), "qs")
    return R.unpack_levels(packed, "qs").select(*keys, *[r8(c) for c in Q])


@query(
    "w7_best_by",
    with_(C.FORECASTS)
    + """, m AS (SELECT model, series_id, tau, origin, avg(-qs) AS s FROM sc GROUP BY 1, 2, 3, 4),
a AS (SELECT series_id, tau, model, avg(s) AS mean_score, stddev_pop(s) AS std_score, count(s) AS folds FROM m GROUP BY 1, 2, 3),
b AS (SELECT *, rank() OVER (PARTITION BY series_id, tau ORDER BY mean_score DESC) AS rk FROM a)
SELECT series_id, tau, model, round(mean_score + 1e-11, 8) AS mean_score, round(std_score + 1e-11, 8) AS std_score, folds, CAST(rk AS INTEGER) AS rank
FROM b WHERE rk = 1""",
)
def w7(spark, root):
    scores = E.score(baseline(spark, root)).withColumn("score", -F.col("qs"))
    per_fold = scores.groupBy("series_id", "tau", "model", "origin").agg(F.avg("score").alias("score"))
    ranked = E.fold_summary(per_fold, ["model"], within=["series_id", "tau"])
    best = best_by(ranked, ["series_id", "tau"], "rank", ties=("model",))
    return best.select("series_id", "tau", "model", r8("mean_score"), r8("std_score"), "folds", "rank")


@query(
    "k_roundtrip",
    with_(C.FORECASTS)
    + """SELECT model, origin, tau, count(*) AS n, round(sum(q), 4) AS total_q, round(sum(y), 4) AS total_y FROM fc GROUP BY 1, 2, 3""",
)
def k_roundtrip(spark, root):
    path = os.path.join(checkpoint_dir(spark), f"forecasts-{uuid.uuid4().hex}")
    write_forecasts(baseline(spark, root), path)
    back = read_forecasts(spark, path)
    return back.groupBy("model", "origin", "tau").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("q"), 4).alias("total_q"), F.round(F.sum("y"), 4).alias("total_y")
    )
