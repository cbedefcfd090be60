"""Order-dependent operators that cut a long series into blocks.

A series may hold a large part of all rows, so nothing here sorts a whole series in one task: rows are numbered
per (series, span of days), and windows run per (series, block of positions) with the few rows a block
needs from its predecessor copied in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_DAYS = 366
BLOCK_ROWS = 4096


def span_of(ts: str, days: int = SPAN_DAYS) -> Column:
    return F.floor(F.unix_date(F.to_date(F.col(ts))) / F.lit(days)).cast("int")


def with_position(df: DataFrame, keys: list[str], ts: str, days: int = SPAN_DAYS) -> DataFrame:
    """Adds `pos`, the 1-based place in the series, and `n_rows`, its length."""
    spans = df.withColumn("_span", span_of(ts, days))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spans.groupBy(*keys, "_span")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("n_rows", F.sum("_n").over(Window.partitionBy(*keys)))
        .drop("_n")
    )
    local = spans.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(ts)))
    return (
        local.join(offsets, [*keys, "_span"])
        .withColumn("pos", F.col("_offset") + F.col("_local"))
        .drop("_span", "_local", "_offset")
    )


def into_blocks(df: DataFrame, before: int, after: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `block` and `own` to a frame that has `pos`.

    A block also gets the last `before` rows of its predecessor and the first `after` rows of its successor,
    with `own` false.
    """
    if max(before, after) > block_rows:
        raise ValueError("a block must be at least as long as its halo")
    home = F.floor((F.col("pos") - 1) / F.lit(block_rows)).cast("int")
    place = (F.col("pos") - 1) % block_rows
    none = F.array().cast("array<int>")
    homes = F.concat(
        F.array(home),
        F.when(place >= block_rows - before, F.array(home + 1)).otherwise(none),
        F.when((place < after) & (home > 0), F.array(home - 1)).otherwise(none),
    )
    return df.withColumn("block", F.explode(homes)).withColumn("own", F.col("block") == home)


def with_lags(
    df: DataFrame, keys: list[str], lags: dict[str, tuple[str | Column, int]], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Positional lags of a frame that has `pos`: new column -> (source, steps back)."""
    deepest = max(k for _, k in lags.values())
    w = Window.partitionBy(*keys, "block").orderBy("pos")
    blocks = into_blocks(df, deepest, block_rows=block_rows)
    cols = {
        name: F.lag(F.col(src) if isinstance(src, str) else src, k).over(w) for name, (src, k) in lags.items()
    }
    return blocks.withColumns(cols).filter("own").drop("block", "own")


def with_returns(
    prices: DataFrame,
    keys: list[str],
    steps: tuple[int, ...] = (1, 2, 3, 4, 5),
    kind: str = "log",
    price: str = "price",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """h-step percent returns `ret1`, `ret2`, ... of a frame that has `pos`; the first h are null.

    Returns of more than one step overlap: there is one for every day.
    """
    p = F.col(price)
    lagged = with_lags(prices, keys, {f"_p{h}": (price, h) for h in steps}, block_rows)
    if kind == "log":
        cols = {f"ret{h}": (F.log(p) - F.log(f"_p{h}")) * 100 for h in steps}
    elif kind == "exact":
        cols = {f"ret{h}": (p - F.col(f"_p{h}")) * 100 / F.col(f"_p{h}") for h in steps}
    else:
        raise ValueError(f"unknown kind of return: {kind}")
    return lagged.withColumns(cols).drop(*[f"_p{h}" for h in steps])


def with_squared_lags(
    returns: DataFrame, keys: list[str], lags: tuple[int, ...] = (1, 2, 3, 4, 5), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """`ret_sqrd_lag1`, ... from the squared one-step return."""
    squared = returns.withColumn("ret1_sqrd", F.pow(F.col("ret1"), F.lit(2)))
    return with_lags(squared, keys, {f"ret_sqrd_lag{k}": ("ret1_sqrd", k) for k in lags}, block_rows)


def at_origins(day: Column, origins: list, after: bool = True, span: int = 7) -> Column:
    """Array of the origins that have `day` within `span` days after them, or at or after `day`."""
    known = F.array(*[F.lit(o) for o in origins])
    if after:
        return F.filter(known, lambda o: (day > o) & (day <= F.date_add(o, span)))
    return F.filter(known, lambda o: day <= o)


def cumulative_return(returns: DataFrame, keys: list[str], origins: list, span: int = 7) -> DataFrame:
    """Running sum of the one-step return over the days after each origin."""
    rows = returns.withColumn("origin", F.explode(at_origins(F.col("date"), origins, span=span)))
    w = Window.partitionBy(*keys, "origin").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ret", F.sum("ret1").over(w)).select(*keys, "origin", "date", "ret")


def time_folds(df: DataFrame, k: int, test_rows: int) -> DataFrame:
    """Expanding folds of a frame that has `pos` and `n_rows`.

    Fold i (from 0) tests on a stretch of `test_rows` rows and trains on everything before it; the last fold
    ends at the last row. One output row per (row, fold) it takes part in, with `part`.
    """
    start = lambda i: F.col("n_rows") - (F.lit(k) - i) * test_rows
    folds = F.filter(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: (F.col("pos") <= start(i) + test_rows) & (start(i) > 0),
    )
    exploded = df.withColumn("fold", F.explode(folds))
    first_test = F.col("n_rows") - (F.lit(k) - F.col("fold")) * test_rows
    return exploded.withColumn("part", F.when(F.col("pos") > first_test, "test").otherwise("train"))


def skip_first(df: DataFrame, keys: list[str], ts: str, n: int) -> DataFrame:
    """Drops the oldest `n` rows of every series."""
    return with_position(df, keys, ts).filter(F.col("pos") > n).drop("pos", "n_rows")


def best_by(df: DataFrame, keys: list[str], criterion: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The row with the smallest criterion per key as an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(criterion, *ties) if ties else F.col(criterion)
    best = df.filter(F.col(criterion).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])
