"""Model fitting as passes over blocks.

Every iterative model here has the same shape. The observations of a series lie in blocks: one row per
(keys, block) with bounded arrays, so a long series is many rows on many tasks. The parameters lie in a
state frame: one row per keys with an array `p`. A pass attaches the parameters to the blocks, lets each
task reduce its blocks to one vector of sums per key, adds those vectors up per key and solves for the new
parameters, where the group that solves holds one row per task, not per observation.

If a count shows that there are few models, their parameters stay on the driver and a pass is a single stage whose
sums come back to it. Otherwise they stay in a frame and are solved for where their sums meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreband.core import cut, is_small, parallelism, ship
from foreband.operators.ordered import BLOCK_ROWS, into_blocks, span_of

Mapper = Callable[[dict, np.ndarray], np.ndarray]
Reducer = Callable[[np.ndarray, np.ndarray], np.ndarray]

# Blocks per Arrow batch; a block holds thousands of observations.
BATCH_BLOCKS = 64
# Above this many map tasks the vectors are added in two steps.
FAN_IN = 256
# Up to this many models the driver keeps the parameters and solves for them itself.
FEW_MODELS = 1000
# Up to this many map tasks it also adds their sums.
DIRECT_TASKS = 64


@contextmanager
def block_batches(spark: SparkSession, rows: int = BATCH_BLOCKS):
    """Small Arrow batches while an action runs, since every row is a whole block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run(df: DataFrame | Few) -> DataFrame | Few:
    """Computes a frame of block work now and cuts its lineage."""
    if isinstance(df, Few):
        return df
    ship(df.sparkSession)
    with block_batches(df.sparkSession):
        return cut(df)


def feature_blocks(df: DataFrame, keys: list[str], ts: str, y: str, features: list[Column], span_days: int = 128) -> DataFrame:
    """Blocks for models that need no order: `y` and the row-major feature matrix `x`, per span of days."""
    row = F.struct(F.col(y).cast("double").alias("y"), F.array(*[f.cast("double") for f in features]).alias("x"))
    usable = df.select(*keys, span_of(ts, span_days).alias("block"), row.alias("_r"))
    usable = usable.filter(F.col("_r.y").isNotNull() & ~F.exists("_r.x", lambda v: v.isNull()))
    blocks = usable.groupBy(*keys, "block").agg(F.collect_list("_r").alias("_r"))
    return spread(blocks.select(*keys, "block", F.col("_r.y").alias("y"), F.flatten("_r.x").alias("x")), keys)


def ordered_blocks(
    df: DataFrame, keys: list[str], columns: list[str], before: int, after: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Blocks of a frame that has `pos`, in order, with halo rows; `lead` counts the halo rows in front."""
    rows = into_blocks(df, before, after, block_rows)
    blocks = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "own", *columns))).alias("_r"))
    own = F.col("_r.own")
    first = F.array_position(own, True).cast("int")
    return spread(
        blocks.select(
            *keys,
            "block",
            (first - 1).alias("lead"),
            F.size(F.filter(own, lambda o: o)).alias("n_own"),
            *[F.col("_r")[c].alias(c) for c in ("pos", *columns)],
        ),
        keys,
    )


def spread(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Spreads the blocks of every key over all tasks."""
    return blocks.repartition(parallelism(blocks.sparkSession), *keys, "block")


def key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def vector(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.DoubleType()))


SPARSE = [T.StructField("i", T.ArrayType(T.IntegerType())), vector("s"), T.StructField("size", T.IntegerType())]


def block_rows_of(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, dict]]:
    cols = list(pdf.columns)
    for row in pdf.itertuples(index=False, name=None):
        block = dict(zip(cols, row))
        yield tuple(block[k] for k in keys), block


class Few:
    """Parameters of few models on the driver; models not listed have the default."""

    def __init__(self, values: dict[tuple, np.ndarray], default: list[float] | None = None):
        self.values = values
        self.default = None if default is None else np.asarray(default, dtype=float)

    def frame(self, blocks: DataFrame, keys: list[str]) -> DataFrame:
        schema = T.StructType([*key_fields(blocks, keys), vector("p")])
        rows = [(*k, p.tolist()) for k, p in self.values.items()]
        return blocks.sparkSession.createDataFrame(rows, schema, verifySchema=False)


State = DataFrame | list[float] | Few


def few_models(blocks: DataFrame, keys: list[str]) -> bool:
    return is_small(blocks.select(*keys).distinct(), FEW_MODELS)


def as_frame(state: DataFrame | Few, blocks: DataFrame, keys: list[str]) -> DataFrame:
    return state.frame(blocks, keys) if isinstance(state, Few) else state


def attach_state(blocks: DataFrame, state: DataFrame | list[float], keys: list[str]) -> DataFrame:
    """Blocks with the parameters of their key, or with the same given ones.

    Parameters known to be few are broadcast, so blocks stay on their tasks.
    """
    if isinstance(state, list):
        return blocks.withColumn("p", F.array(*[F.lit(float(v)) for v in state]).cast("array<double>"))
    return blocks.join(state, keys)


def sums(blocks: DataFrame, state: State, keys: list[str], mapper: Mapper) -> DataFrame:
    """Per key the current `p` and partial sums of the mapper's vectors, one per task.

    A sum travels as the places `i` and values `s` of its non-zero cells; `size` is its length.
    """
    spark = blocks.sparkSession
    slots = 1 if parallelism(spark) <= FAN_IN else math.isqrt(parallelism(spark))
    if isinstance(state, Few):
        shared, default = spark.sparkContext.broadcast(state.values), state.default
        joined = blocks
    else:
        shared, default = None, None
        joined = attach_state(blocks, state, keys)
    joined = joined.withColumn("_slot", F.spark_partition_id() % slots)
    schema = T.StructType([*key_fields(blocks, keys), T.StructField("_slot", T.IntegerType()), vector("p"), *SPARSE])

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, block in block_rows_of(pdf, keys):
                p = np.asarray(block["p"], dtype=float) if shared is None else shared.value.get(key, default)
                part = mapper(block, p)
                if key in held:
                    held[key][2] = held[key][2] + part
                else:
                    held[key] = [block["_slot"], p if shared is None else [], part]
            if len(held) > 512:
                yield _partials(held, keys)
                held = {}
        if held:
            yield _partials(held, keys)

    partials = joined.mapInPandas(reduce_task, schema)
    return partials if slots == 1 else _gather(partials, [*keys, "_slot"], schema, lambda p, s: [p, *_sparse(s)])


def _sparse(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    places = np.flatnonzero(total)
    return places.astype(np.int32), total[places], len(total)


def _gather(partials: DataFrame, by: list[str], schema: T.StructType, finish: Callable) -> DataFrame:
    """Adds the partial sums of each group; finish(p, sum) gives the columns after the keys.

    The partials are gathered on the JVM, a bounded number per group, and groups arrive in Python many at a time.
    """
    gathered = partials.groupBy(*by).agg(
        F.first("p").alias("p"),
        F.flatten(F.collect_list("i")).alias("i"),
        F.flatten(F.collect_list("s")).alias("s"),
        F.first("size").alias("size"),
    )
    names = schema.names

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, row in block_rows_of(pdf, by):
                total = np.bincount(np.asarray(row["i"], dtype=np.int64), weights=row["s"], minlength=row["size"])
                rows.append((*key, *finish(np.asarray(row["p"], dtype=float), total)))
            yield pd.DataFrame(rows, columns=names)

    return gathered.mapInPandas(apply, schema)


def _partials(held: dict, keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([list(k) for k in held], columns=keys)
    out["_slot"] = [v[0] for v in held.values()]
    out["p"] = [v[1] for v in held.values()]
    out["i"], out["s"], out["size"] = zip(*[_sparse(np.asarray(v[2], dtype=float)) for v in held.values()])
    return out


def step(blocks: DataFrame, state: State, keys: list[str], mapper: Mapper, reducer: Reducer) -> DataFrame:
    """One pass: new state from the current one; lazy unless the driver holds it."""
    if isinstance(state, list) and few_models(blocks, keys):
        state = Few({}, state)
    if isinstance(state, Few):
        return _step_few(blocks, state, keys, mapper, reducer)
    schema = T.StructType([*key_fields(blocks, keys), vector("p")])
    return _gather(sums(blocks, state, keys, mapper), keys, schema, lambda p, s: [reducer(p, s)])


def _step_few(blocks: DataFrame, state: Few, keys: list[str], mapper: Mapper, reducer: Reducer) -> Few:
    """A pass for parameters on the driver."""
    spark = blocks.sparkSession
    ship(spark)
    partials = sums(blocks, state, keys, mapper)
    if parallelism(spark) > DIRECT_TASKS:
        schema = T.StructType([*key_fields(blocks, keys), *SPARSE])
        partials = _gather(partials, keys, schema, lambda p, s: _sparse(s))
    with block_batches(spark):
        found = partials.select(*keys, "i", "s", "size").toArrow()
    totals: dict[tuple, np.ndarray] = {}
    columns = [found.column(k).to_pylist() for k in keys]
    places, cells, sizes = found.column("i"), found.column("s"), found.column("size").to_pylist()
    for at, key in enumerate(zip(*columns)):
        total = totals.setdefault(key, np.zeros(sizes[at]))
        total[np.asarray(places[at].values)] += np.asarray(cells[at].values)
    old = lambda key: state.values.get(key, state.default)
    return Few({key: reducer(old(key), total) for key, total in totals.items()})


def changed(state: DataFrame | Few, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame | Few:
    """The state with a function applied to every key's parameters."""
    if isinstance(state, Few):
        return Few({key: change(p) for key, p in state.values.items()}, state.default)
    apply = lambda batches: (pdf.assign(p=[change(np.asarray(p, dtype=float)) for p in pdf["p"]]) for pdf in batches)
    return run(state.mapInPandas(apply, state.schema))


def iterate(
    blocks: DataFrame, state: State, keys: list[str], mapper: Mapper, reducer: Reducer, rounds: int, cut_every: int = 4
) -> DataFrame:
    """Repeats one kind of pass; lineage is cut every few rounds.

    The number of models never changes, so one size check at the start decides whether the parameters are
    broadcast, which leaves the blocks where they are, or joined by key.
    """
    hint = state_hint(blocks, keys)
    for i in range(rounds):
        state = step(blocks, hint(state), keys, mapper, reducer)
        if (i + 1) % cut_every == 0 or i + 1 == rounds:
            state = run(state)
    return as_frame(state, blocks, keys)


def state_hint(blocks: DataFrame, keys: list[str]) -> Callable:
    """Broadcast hint for state frames if a count shows that it is bounded, else no hint."""
    known: list[bool] = []

    def hint(state: State) -> State:
        if not isinstance(state, DataFrame):
            return state
        if not known:
            known.append(is_small(blocks.select(*keys).distinct()))
        return F.broadcast(state) if known[0] else state

    return hint


def solve_spd(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of the normal equations; collinear columns get the smallest coefficients that fit."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    unit = gram / np.outer(scale, scale)
    return np.linalg.pinv(unit, rcond=1e-11, hermitian=True) @ (rhs / scale) / scale
