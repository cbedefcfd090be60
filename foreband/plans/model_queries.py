"""Queries over the models. Where a special case has a closed form, SQL states it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from foreband import LEVELS
from foreband.core import checkpoint_dir
from foreband.functions.dates import in_target_hours
from foreband.functions.scores import pinball
from foreband.models import arma as A
from foreband.models import boost as B
from foreband.models import dist, ets
from foreband.models import garch as G
from foreband.models import linear as L
from foreband.models import passes as P
from foreband.models.stl import stl
from foreband.operators import evaluate as E
from foreband.operators.frames import explode_levels
from foreband.operators.ordered import best_by, with_position
from foreband.operators.timegrid import daily_sums, with_time_lookups
from foreband.plans import catalog as C
from foreband.plans import index_forecast as I
from foreband.plans import load_forecast as LF
from foreband.plans.baseline import load_origins, seasonal_forecasts
from foreband.plans.catalog import query, with_
from foreband.plans.series_queries import SERIES, price_origins, price_returns, r6
from foreband.sources.series import daily_prices, hourly_load

HKEYS = ["series_id", "h"]


# ---- linear models


@query(
    "f1_quantile_regression",
    with_(C.LOAD)
    + """, levels AS (SELECT unnest([0.025, 0.25, 0.5, 0.75, 0.975]::DOUBLE[]) AS tau),
g AS (SELECT series_id, isodow(ts) AS wd, quantile_disc(value, [0.025, 0.25, 0.5, 0.75, 0.975]) AS p FROM load_h GROUP BY 1, 2),
j AS (SELECT l.series_id, tau, value - CASE tau WHEN 0.025 THEN p[1] WHEN 0.25 THEN p[2] WHEN 0.5 THEN p[3] WHEN 0.75 THEN p[4] ELSE p[5] END AS r
      FROM load_h l JOIN g ON g.series_id = l.series_id AND g.wd = isodow(l.ts), levels)
SELECT series_id, tau, round(avg(greatest(tau * r, (tau - 1) * r)), 2) AS loss, count(*) AS n FROM j GROUP BY 1, 2""",
)
def f1(spark, root):
    load = hourly_load(spark, root)
    columns = [F.lit(1.0), *L.dummies(F.weekday("ts"), range(7))]
    blocks = P.run(P.feature_blocks(load, SERIES, "ts", "value", columns, 16))
    coefs = L.quantile_regression(blocks, SERIES, len(columns), rounds=30)
    rows = explode_levels(L.predict_levels(load, coefs, SERIES, columns), "q")
    loss = F.avg(pinball(F.col("value"), F.col("q"), F.col("tau")))
    return rows.groupBy("series_id", "tau").agg(F.round(loss, 2).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("f2_load_regression_forecasts")
def f2(spark, root):
    return LF.regression_forecasts(spark, hourly_load(spark, root), load_origins(spark, root))


@query(
    "f4_ols",
    with_(C.LAGS)
    + """SELECT series_id, round(regr_slope(value, lag7), 6) AS slope, round(regr_intercept(value, lag7), 6) AS intercept,
  round(regr_syy(value, lag7) * (1 - regr_r2(value, lag7)) / (regr_count(value, lag7) - 2), 4) AS sigma2, regr_count(value, lag7)::BIGINT AS n
FROM lagged GROUP BY 1""",
)
def f4(spark, root):
    lagged = with_time_lookups(hourly_load(spark, root), SERIES, {"lag7": "7 days"})
    blocks = P.run(P.feature_blocks(lagged, SERIES, "ts", "value", [F.lit(1.0), F.col("lag7")], 16))
    fit = L.ols(blocks, SERIES, ["intercept", "slope"])
    of = lambda term: F.max(F.when(F.col("term") == term, F.col("coef")))
    return fit.groupBy("series_id").agg(
        F.round(of("slope"), 6).alias("slope"),
        F.round(of("intercept"), 6).alias("intercept"),
        F.round(F.max("sigma2"), 4).alias("sigma2"),
        F.max("n").alias("n"),
    )


@query("f5_stepwise")
def f5(spark, root):
    origins = load_origins(spark, root)
    frame = LF.regression_frame(spark, hourly_load(spark, root), origins)
    columns, owned = LF.regression_terms(frame)
    keys = ["series_id", "origin"]
    blocks = P.run(P.feature_blocks(frame.filter("part = 'train'"), keys, "ts", "value", columns))
    return L.stepwise(blocks, keys, owned, len(columns))


# ---- distributions and mean models


@query(
    "f6_normal_fit",
    with_(C.RETURNS)
    + """SELECT series_id, CAST(h AS INTEGER) AS h, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS deviation,
  round(-count(*) / 2.0 * (ln(2 * pi() * var_pop(y)) + 1), 4) AS loglik, count(*) AS n
FROM (SELECT series_id, unnest([1, 2, 3, 4, 5]) AS h, unnest([ret1, ret2, ret3, ret4, ret5]) AS y FROM rets) WHERE y IS NOT NULL GROUP BY 1, 2""",
)
def f6_normal(spark, root):
    blocks = A.return_blocks(price_returns(spark, root), SERIES, (1, 2, 3, 4, 5))
    fits = dist.fit_distributions(blocks, HKEYS, rounds=1).filter("distribution = 'normal'")
    return fits.select(*HKEYS, r6("estimate1", "mean"), r6("estimate2", "deviation"), F.round("loglik", 4).alias("loglik"), "n")


@query("f6_dist_fit")
def f6(spark, root):
    blocks = A.return_blocks(price_returns(spark, root), SERIES, (1, 2, 3, 4, 5))
    return dist.fit_distributions(blocks, HKEYS)


@query(
    "f7_ar1_fit",
    with_(C.RETURNS)
    + """, y1 AS (SELECT series_id, ret1 AS y, lag(ret1) OVER w AS x, row_number() OVER w AS pos FROM rets WHERE ret1 IS NOT NULL
  WINDOW w AS (PARTITION BY series_id ORDER BY date))
SELECT series_id, round(regr_slope(y, x), 6) AS phi, round(regr_syy(y, x) * (1 - regr_r2(y, x)) / regr_count(y, x), 4) AS sigma2,
  regr_count(y, x)::BIGINT AS n FROM y1 WHERE pos > 18 GROUP BY 1""",
)
def f7_ar1(spark, root):
    blocks = A.return_blocks(price_returns(spark, root), SERIES, (1,))
    fits = A.fit_orders(A.orders(blocks, HKEYS), HKEYS, [1], [0])
    value = lambda i: F.element_at("p", i + 1)
    return fits.select(
        "series_id",
        F.round(value(A.PHI), 6).alias("phi"),
        F.round(value(A.SIGMA2), 4).alias("sigma2"),
        value(A.SIGMA2 + 1).cast("long").alias("n"),
    )


@query("f7_arma_search")
def f7(spark, root):
    blocks = A.return_blocks(price_returns(spark, root), SERIES, (1, 2, 3, 4, 5))
    fits = A.fit_orders(A.orders(blocks, HKEYS), HKEYS, range(1, 7), range(1, 7))
    return E.with_rank(fits.withColumn("_neg", -F.col("bic")), "_neg", HKEYS).drop("_neg", "p")


# ---- volatility

# A fixed ARMA(1,1)-GARCH(1,1): mean 0, phi -.4, theta -.2; omega 500, alpha .05, beta .9; 6 degrees of freedom.
GIVEN_MEAN = {"const": 0.0, "phi": -0.4, "theta": -0.2}
GIVEN_VOL = {"omega": 500.0, "alpha": [0.05], "beta": [0.9], "nu": 6.0}
PATH_SQL = (
    with_(C.RETURNS).replace("WITH", "WITH RECURSIVE", 1)
    + """, y1 AS (SELECT series_id, date, ret1 AS y, row_number() OVER w AS pos, avg(ret1) OVER (PARTITION BY series_id) AS m
       FROM rets WHERE ret1 IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY date)),
path AS (SELECT series_id, date, pos, y, -0.4 * m AS fitted, y + 0.4 * m AS e, 500 + 0.95 * 500 / 0.05::DOUBLE AS s2 FROM y1 WHERE pos = 1
         UNION ALL
         SELECT n.series_id, n.date, n.pos, n.y, -0.4 * p.y - 0.2 * p.e, n.y + 0.4 * p.y + 0.2 * p.e, 500 + 0.05 * p.e * p.e + 0.9 * p.s2
         FROM path p JOIN y1 n ON n.series_id = p.series_id AND n.pos = p.pos + 1)"""
)


def given_residuals(spark, root, block_rows: int = 512):
    """Residual blocks of the first returns under the given mean model."""
    blocks = A.return_blocks(price_returns(spark, root), SERIES, (1,), block_rows=block_rows)
    means = A.given_parameters(blocks, HKEYS, **GIVEN_MEAN)
    return P.run(A.residual_blocks(blocks, means, HKEYS))


@query("f9_garch_filter", PATH_SQL + "SELECT series_id, date, round(fitted, 6) AS fitted, round(sqrt(s2), 6) AS sigma FROM path")
def f9(spark, root):
    residuals = given_residuals(spark, root)
    path = G.paths(residuals, G.given_parameters(residuals, HKEYS, **GIVEN_VOL), HKEYS)
    return path.select("series_id", "date", r6("fitted"), r6("sigma"))


@query(
    "f10_garch_forecast",
    PATH_SQL
    + """, tail AS (SELECT p.* FROM path p JOIN (SELECT series_id, max(pos) AS pos FROM path GROUP BY 1) l ON p.series_id = l.series_id AND p.pos = l.pos),
one AS (SELECT series_id, -0.4 * y - 0.2 * e AS m1, 500 + 0.05 * e * e + 0.9 * s2 AS v1 FROM tail)
SELECT series_id, CAST(k AS INTEGER) AS step, round(m1 * pow(-0.4, k - 1), 6) AS mean,
  round(sqrt(500 / 0.05 * (1 - pow(0.95, k - 1)) + pow(0.95, k - 1) * v1), 6) AS sigma FROM one, (SELECT unnest([1, 2, 3, 4, 5]) AS k)""",
)
def f10(spark, root):
    residuals = given_residuals(spark, root)
    ahead = G.forecast(residuals, G.given_parameters(residuals, HKEYS, **GIVEN_VOL), HKEYS)
    return ahead.select("series_id", "step", r6("mean"), r6("sigma"))


@query(
    "f11_t_quantiles",
    with_(C.RETURNS)
    + """, levels AS (SELECT unnest([0.025, 0.25, 0.5, 0.75, 0.975]::DOUBLE[]) AS tau)
SELECT series_id, tau, round(m + s * (2 * tau - 1) / sqrt(2 * tau * (1 - tau)), 3) AS q
FROM (SELECT series_id, avg(ret1) AS m, stddev_pop(ret1) AS s FROM rets GROUP BY 1), levels""",
)
def f11(spark, root):
    moments = price_returns(spark, root).groupBy("series_id").agg(
        F.avg("ret1").alias("mean"), F.stddev_pop("ret1").alias("sigma"), F.lit(2.0).alias("shape")
    )
    rows = explode_levels(G.quantile_forecasts(moments), "q")
    return rows.select("series_id", "tau", F.round("q", 3).alias("q"))


@query("f8_garch_search")
def f8(spark, root):
    blocks = A.return_blocks(price_returns(spark, root), SERIES, (1, 2, 3, 4, 5))
    residuals = P.run(A.residual_blocks(blocks, I.chosen_orders(blocks, HKEYS), HKEYS))
    found = G.search_orders(residuals, HKEYS, 6, 6)
    return E.with_rank(found.withColumn("_neg", -F.col("bic")), "_neg", HKEYS).drop("_neg", "g")


@query("f3_arma_garch_forecasts")
def f3(spark, root):
    return I.arma_garch_forecasts(daily_prices(spark, root), price_origins(spark, root))


@query("f12_volatility_frame")
def f12(spark, root):
    return I.volatility_frame(daily_prices(spark, root), price_origins(spark, root)[-1:])


@query("f1_index_regression_forecasts")
def f1_index(spark, root):
    return I.regression_forecasts(spark, daily_prices(spark, root), price_origins(spark, root)[-4:])


# ---- trend


@query("f13_stl")
def f13(spark, root):
    daily = with_position(daily_sums(hourly_load(spark, root), SERIES), SERIES, "date")
    return stl(daily, SERIES, "date", "value")


@query(
    "f14_smoothing_given",
    with_(C.PRICES).replace("WITH", "WITH RECURSIVE", 1)
    + """, p AS (SELECT series_id, price, row_number() OVER (PARTITION BY series_id ORDER BY date) AS pos FROM px),
lvl AS (SELECT series_id, pos, price AS l FROM p WHERE pos = 2
        UNION ALL SELECT n.series_id, n.pos, 0.3 * n.price + 0.7 * o.l FROM lvl o JOIN p n ON n.series_id = o.series_id AND n.pos = o.pos + 1)
SELECT l.series_id, CAST(k AS INTEGER) AS step, round(l.l, 4) AS value
FROM lvl l JOIN (SELECT series_id, max(pos) AS pos FROM p GROUP BY 1) e ON e.series_id = l.series_id AND e.pos = l.pos, (SELECT unnest([1, 2, 3]) AS k)""",
)
def f14_given(spark, root):
    px = with_position(daily_prices(spark, root), SERIES, "date")
    blocks = ets.trend_blocks(px, SERIES, "price", 512)
    ahead = ets.forecast(blocks, ets.given_parameters(blocks, SERIES, 0.3, 0.0, 0.0), SERIES)
    return ahead.select("series_id", "step", F.round("value", 4).alias("value"))


@query("f14_ets")
def f14(spark, root):
    daily = with_position(daily_sums(hourly_load(spark, root), SERIES), SERIES, "date")
    parts = stl(daily, SERIES, "date", "value")
    blocks = ets.trend_blocks(parts, SERIES, "trend")
    return ets.fit(blocks, SERIES).drop("p")


# ---- boosting


@query("f15_quantile_boost")
def f15(spark, root):
    """Forecasts of 200 rounds for every origin and level."""
    return LF.boosted_forecasts(spark, hourly_load(spark, root), load_origins(spark, root))


@query(
    "f15_saturated_boost",
    with_(C.LOAD)
    + """, levels AS (SELECT unnest([0.025, 0.25, 0.5, 0.75, 0.975]::DOUBLE[]) AS tau),
g AS (SELECT series_id, isodow(ts) > 5 AS weekend, quantile_disc(value, [0.025, 0.25, 0.5, 0.75, 0.975]) AS p FROM load_h GROUP BY 1, 2)
SELECT series_id, tau, CAST(weekend AS INTEGER) AS weekend,
  round(CASE tau WHEN 0.025 THEN p[1] WHEN 0.25 THEN p[2] WHEN 0.5 THEN p[3] WHEN 0.75 THEN p[4] ELSE p[5] END, 6) AS q FROM g, levels""",
)
def f15_saturated(spark, root):
    """One full step with a leaf for weekdays and one for weekends gives the quantiles of both."""
    load = P.cut(hourly_load(spark, root))
    weekend = (F.weekday("ts") > 4).cast("int")
    edges = load.groupBy(*SERIES).agg(F.array(F.array(F.lit(0.5))).alias("edges"))
    blocks = B.coded_blocks(load, SERIES, "ts", "value", F.lit(0), [weekend], edges, 32)
    specs = [B.Spec(t, 1, 1.0) for t in LEVELS]
    rows = B.prediction_rows(B.fit(blocks, SERIES, ["weekend"], specs, 1).blocks, SERIES, specs, test_only=False)
    return rows.groupBy(*SERIES, "tau", weekend.alias("weekend")).agg(F.round(F.max("q"), 6).alias("q"))


def full_boost(spark, root, rounds: int = 200):
    specs = LF.origin_specs(load_origins(spark, root))
    return B.fit(LF.boost_blocks(spark, hourly_load(spark, root)), SERIES, list(LF.BOOST_FEATURES), specs, rounds)


@query("f17_importance")
def f17(spark, root):
    return B.importance(full_boost(spark, root))


@query("f18_grid_search")
def f18(spark, root):
    """All settings of the search, on folds of 168 rows: 50, or as many as the shortest series has room for."""
    load = P.cut(hourly_load(spark, root))
    return E.fold_summary(LF.grid_search(spark, load, LF.folds_within(load, 50, 168), 168), ["depth", "rate", "trees"], within=["series_id", "tau"])


@query("f19_model_roundtrip")
def f19(spark, root):
    """Saves a model, reads it back and predicts with it; `worst` is the largest change in any prediction."""
    model = full_boost(spark, root)
    path = os.path.join(checkpoint_dir(spark), f"boosted-{uuid.uuid4().hex}")
    B.save(model, path)
    blank = model.blocks.withColumn("f", F.array().cast("array<double>"))
    again = B.predict(B.load(blank, SERIES, path), blank).select(*SERIES, "block", F.col("f").alias("g"))
    change = F.array_max(F.zip_with("f", "g", lambda a, b: F.abs(a - b)))
    return model.blocks.join(again, [*SERIES, "block"]).groupBy(*SERIES).agg(F.max(change).alias("worst"))


# ---- backtest


@query("f20_index_backtest")
def f20_index(spark, root):
    """Scores of both price models by horizon over the last four origins, for days that have a price."""
    prices, origins = P.cut(daily_prices(spark, root)), price_origins(spark, root)[-4:]
    forecasts = I.arma_garch_forecasts(prices, origins).unionByName(I.regression_forecasts(spark, prices, origins))
    cases = E.wide_scores(E.score(forecasts.filter("y IS NOT NULL")), ["model", "series_id", "origin", "date", "horizon"])
    return E.means_with_overall(cases, ["model"], "horizon", E.score_columns())


@query("f20_backtest")
def f20(spark, root):
    """Leaderboard of three models over all origins, scored on the same target hours."""
    load = P.cut(hourly_load(spark, root))
    origins = load_origins(spark, root)
    forecasts = (
        seasonal_forecasts(load, origins)
        .unionByName(LF.regression_forecasts(spark, load, origins))
        .unionByName(LF.boosted_forecasts(spark, load, origins))
    )
    return E.leaderboard(E.wide_scores(E.score(forecasts.filter(in_target_hours(F.col("ts"))))), ["model"])
