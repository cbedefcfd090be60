"""Daily prices: ARMA-GARCH and quantile regression with a volatility regressor, for many origins in one job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreband import LEVELS
from foreband.core import broadcast_if_small
from foreband.functions.calendar import holidays, on_trading_days, trading_days, trading_targets
from foreband.models import arma as A
from foreband.models import garch as G
from foreband.models import linear as L
from foreband.models import passes as P
from foreband.operators.frames import explode_levels, with_holiday_flag
from foreband.operators.ordered import best_by, cumulative_return, with_position, with_returns, with_squared_lags
from foreband.operators.timegrid import time_bounds

SERIES = ["series_id"]
KEYS = ["series_id", "h", "origin"]
STEPS = (1, 2, 3, 4, 5)


def returns_of(prices: DataFrame, steps=STEPS) -> DataFrame:
    return with_returns(with_position(prices, SERIES, "date"), SERIES, steps)


def fixed_orders(blocks: DataFrame, keys: list[str], p: int = 1, q: int = 1) -> DataFrame:
    return P.run(A.fit_orders(A.orders(blocks, keys), keys, [p], [q]))


def chosen_orders(blocks: DataFrame, keys: list[str], max_p: int = 6, max_q: int = 6) -> DataFrame:
    """Mean-model orders with the smallest BIC."""
    fits = A.fit_orders(A.orders(blocks, keys), keys, range(1, max_p + 1), range(1, max_q + 1))
    return P.run(best_by(fits, keys, "bic", ties=("p_order", "q_order")))


def volatility(
    blocks: DataFrame, keys: list[str], means: DataFrame, max_p: int = 1, max_q: int = 1, innovations: str = "t"
) -> tuple[DataFrame, DataFrame]:
    """Residual blocks and, per key, the volatility order with the smallest BIC."""
    residuals = P.run(A.residual_blocks(blocks, means, keys))
    found = G.search_orders(residuals, keys, max_p, max_q, innovations)
    return residuals, P.run(best_by(found, keys, "bic", ties=("garch_p", "garch_q")))


def price_calendar(spark: SparkSession, prices: DataFrame) -> DataFrame:
    """Trading days from the first price to two weeks after the last."""
    first, last = time_bounds(prices, "date")
    last += dt.timedelta(days=14)
    return P.cut(trading_days(spark, first, last, holidays(spark, first.year, last.year)))


def future_days(prices: DataFrame, origins: list, n: int = 5) -> DataFrame:
    """The next n trading days after each origin: origin, step, date, horizon in calendar days."""
    return F.broadcast(trading_targets(price_calendar(prices.sparkSession, prices), origins, n))


def traded(prices: DataFrame) -> DataFrame:
    """Prices of trading days."""
    return on_trading_days(prices, price_calendar(prices.sparkSession, prices))


def with_actual_returns(cases: DataFrame, returns: DataFrame, origins: list) -> DataFrame:
    """Joins the cumulative return since the origin by date; days without a price have none."""
    y = cumulative_return(returns, SERIES, origins).select("series_id", "origin", "date", F.col("ret").alias("y"))
    return cases.join(y, ["series_id", "origin", "date"], "left")


def arma_garch_forecasts(
    prices: DataFrame, origins: list, levels=LEVELS, max_p: int = 1, max_q: int = 1, standardized: bool = False
) -> DataFrame:
    """Long forecasts: model, series_id, origin, date, horizon, tau, y, q."""
    prices = P.cut(traded(prices))
    returns = P.cut(returns_of(prices))
    blocks = A.return_blocks(returns, SERIES, STEPS, origins)
    residuals, fits = volatility(blocks, KEYS, chosen_orders(blocks, KEYS), max_p, max_q)
    steps = G.diagonal(G.forecast(residuals, fits, KEYS, max(STEPS)))
    cases = G.quantile_forecasts(steps, levels, standardized).join(future_days(prices, origins), ["origin", "step"])
    rows = with_actual_returns(cases, returns, origins).select(
        F.lit("arma_garch").alias("model"), "series_id", "origin", "date", "horizon", "y", "q"
    )
    return explode_levels(rows, "q", levels)


def volatility_frame(prices: DataFrame, origins: list) -> DataFrame:
    """Fitted mean and deviation of the fixed (1,1)-(1,1) model: history, then the forecast steps.

    Columns series_id, h, origin, date, step and horizon (null in history), fitted, sigma.
    """
    prices = P.cut(traded(prices))
    blocks = A.return_blocks(returns_of(prices), SERIES, STEPS, origins)
    residuals, fits = volatility(blocks, KEYS, fixed_orders(blocks, KEYS), 1, 1, "normal")
    past = G.paths(residuals, fits, KEYS).select(*KEYS, "date", "fitted", "sigma")
    ahead = G.forecast(residuals, fits, KEYS, max(STEPS)).join(future_days(prices, origins), ["origin", "step"])
    return past.unionByName(
        ahead.select(*KEYS, "date", "step", "horizon", F.col("mean").alias("fitted"), "sigma"), allowMissingColumns=True
    )


def regression_forecasts(
    spark: SparkSession, prices: DataFrame, origins: list, levels=LEVELS, rounds: int = 20
) -> DataFrame:
    """h-step return on its squared-return lag, weekday, holiday and volatility, for every h and origin."""
    prices = P.cut(traded(prices))
    returns = P.cut(returns_of(prices))
    first, last = time_bounds(prices, "date")
    lagged = with_squared_lags(returns, SERIES)
    names = [F.struct(F.lit(h).alias("h"), F.col(f"ret{h}").alias("ret"), F.col(f"ret_sqrd_lag{h}").alias("sq")) for h in STEPS]
    known = lagged.select("series_id", "date", F.inline(F.array(*names)))
    volatile = P.run(volatility_frame(prices, origins))
    # For the day h rows after the origin, the squared return h rows earlier is the origin's own.
    latest = returns.select("series_id", "date", "ret1").withColumn("origin", F.explode(F.array(*[F.lit(o) for o in origins])))
    latest = (
        latest.filter("date <= origin AND ret1 IS NOT NULL")
        .groupBy("series_id", "origin")
        .agg(F.pow(F.max_by("ret1", "date"), F.lit(2)).alias("_sq"))
    )
    frame = (
        volatile.join(known, ["series_id", "h", "date"], "left")
        .join(broadcast_if_small(latest), ["series_id", "origin"])
        .withColumn("sq", F.when(F.col("step").isNull(), F.col("sq")).otherwise(F.col("_sq")))
        .withColumn("weekday", F.weekday("date"))
    )
    frame = P.cut(with_holiday_flag(frame, holidays(spark, first.year, last.year + 1)))
    columns = [F.lit(1.0), F.col("sq"), *L.dummies(F.col("weekday"), range(7)), F.col("is_holiday"), F.col("sigma")]
    blocks = P.run(P.feature_blocks(frame.filter("step IS NULL"), KEYS, "date", "ret", columns, 1024))
    coefs = L.quantile_regression(blocks, KEYS, len(columns), levels, rounds)
    ahead = frame.filter("step = h").drop("ret")
    cases = with_actual_returns(L.predict_levels(ahead, coefs, KEYS, columns, levels), returns, origins).select(
        F.lit("quantile_regression").alias("model"), "series_id", "origin", "date", "horizon", "y", "q"
    )
    return explode_levels(cases, "q", levels)
