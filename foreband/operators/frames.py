"""Splits, joins and reshapes of series, forecast and score frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreband import LEVELS
from foreband.core import broadcast_if_small
from foreband.functions.numbers import level_name


def split_at_origins(df: DataFrame, origins: list, days_ahead: int, ts: str = "ts") -> DataFrame:
    """One row per (row, origin) with `part` = train up to the end of the origin day, else test.

    The test part ends `days_ahead` days after the origin. The origins are a short list of dates from
    the caller, so a row finds its own without a join.
    """
    day = F.to_date(ts)
    known = F.array(*[F.lit(o) for o in origins])
    rows = df.withColumn("origin", F.explode(F.filter(known, lambda o: day <= F.date_add(o, days_ahead))))
    return rows.withColumn("part", F.when(day <= F.col("origin"), "train").otherwise("test"))


def with_holiday_flag(df: DataFrame, holidays: DataFrame, day: str = "date") -> DataFrame:
    """`is_holiday` 1 or 0 from a calendar table with a `date` column."""
    marks = holidays.select(F.col("date").alias(day), F.lit(1).alias("_hit")).distinct()
    return df.join(broadcast_if_small(marks), day, "left").withColumn("is_holiday", F.coalesce("_hit", F.lit(0))).drop("_hit")


def attach(df: DataFrame, side: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi join with a dimension-like side, broadcast when a count shows it is small."""
    return df.join(broadcast_if_small(side), on, how)


def history_and_future(features: DataFrame, known: DataFrame, future: DataFrame, on: list[str]) -> DataFrame:
    """All rows of history plus forecast times, with the features where they exist."""
    spine = known.unionByName(future, allowMissingColumns=True)
    return features.join(spine, on, "right")


def forecasts_with_actuals(actuals: DataFrame, forecasts: DataFrame, on: list[str]) -> DataFrame:
    """Actuals keep their rows; forecasts match by key, never by row number."""
    return actuals.join(forecasts, on, "left")


def compare_models(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left")


def members(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    return df.join(wanted.select(*on), on, "left_semi")


def drop_if_any_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=cols)


def null_report(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per key: number of rows, and per column its number of nulls and whether it has any."""
    counts = [F.sum(F.col(c).isNull().cast("long")).alias(f"n_null_{c}") for c in cols]
    flags = [F.max(F.col(c).isNull()).alias(f"any_null_{c}") for c in cols]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *counts, *flags)


def grid(**values: list) -> Column:
    """Array of structs with every combination of the values, to explode in a projection."""
    combos = None
    for name, options in values.items():
        axis = F.array(*[F.lit(o) for o in options])
        combos = _axis(axis, name) if combos is None else _extend(combos, axis, name)
    return combos


def _axis(axis: Column, name: str) -> Column:
    return F.transform(axis, lambda v: F.struct(v.alias(name)))


def _extend(combos: Column, axis: Column, name: str) -> Column:
    return F.flatten(F.transform(combos, lambda c: F.transform(axis, lambda v: c.withField(name, v))))


def levels_to_rows(df: DataFrame, ids: list[str], prefix: str = "q", levels=LEVELS, value: str = "q") -> DataFrame:
    """Wide to long: one row per quantile level with numeric `tau`."""
    names = [level_name(prefix, t) for t in levels]
    wide = df.unpivot(ids, names, "_name", value)
    tau = F.element_at(F.create_map(*[x for t, n in zip(levels, names) for x in (F.lit(n), F.lit(t))]), F.col("_name"))
    return wide.select(*ids, tau.alias("tau"), value)


def levels_to_columns(df: DataFrame, ids: list[str], prefix: str = "q", levels=LEVELS, value: str = "q") -> DataFrame:
    """Long to wide: one column per quantile level."""
    cols = [F.max(F.when(F.col("tau") == F.lit(t), F.col(value))).alias(level_name(prefix, t)) for t in levels]
    return df.groupBy(*ids).agg(*cols)


def unpack_levels(df: DataFrame, array: str, prefix: str = "q", levels=LEVELS) -> DataFrame:
    """Array column with one element per level to one column per level."""
    cols = {level_name(prefix, t): F.element_at(array, i + 1) for i, t in enumerate(levels)}
    return df.withColumns(cols).drop(array)


def explode_levels(df: DataFrame, array: str, levels=LEVELS, value: str = "q") -> DataFrame:
    """Array column with one element per level to one row per level."""
    keep = [c for c in df.columns if c != array]
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in levels]).alias("tau"), F.col(array).alias(value))
    return df.select(*keep, F.inline(pairs))


def flip(df: DataFrame, name: str, columns: list, metrics: list[str]) -> DataFrame:
    """Transposes a small result: `metric` becomes the row, the values of `name` become columns."""
    long = df.unpivot([name], metrics, "metric", "_v")
    cols = [F.max(F.when(F.col(name) == F.lit(c), F.col("_v"))).alias(str(c)) for c in columns]
    return long.groupBy("metric").agg(*cols)


def monotone(df: DataFrame, array: str) -> DataFrame:
    """Sorts the levels of a forecast, which removes crossing quantiles."""
    return df.withColumn(array, F.sort_array(array))
