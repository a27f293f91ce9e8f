"""Cluster bootstrap: groups are summed once, draws are made on executors, and each repetition is an aggregation."""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import ratio

#: Repetitions and seeds.
REPS, SEED = 2000, 20260924
LADDER_SEED = 20260923


#: Repetitions that are replayed from one state of a generator.
BLOCK = 100
DRAWS = "rep int, ord int, times int"


def draws_by_choice(spark: SparkSession, groups: int, reps: int = REPS, seed: int = SEED) -> DataFrame:
    """(rep, ord, times): how often each repetition draws each group, with the standard generator's choice()."""
    rng, order = random.Random(seed), range(groups)

    def states():
        for first in range(0, reps, BLOCK):
            yield first, pickle.dumps(rng.getstate())
            for _ in range(min(BLOCK, reps - first) * groups):
                rng.choice(order)

    def draw(state: bytes, n: int) -> list[list[int]]:
        mine = random.Random()
        mine.setstate(pickle.loads(state))
        return [[mine.choice(range(groups)) for _ in range(groups)] for _ in range(n)]

    return _replayed(spark, list(states()), draw, reps)


def draws_by_integers(spark: SparkSession, groups: int, reps: int = REPS, seed: int = LADDER_SEED) -> DataFrame:
    """The same with numpy's integers()."""
    rng = np.random.default_rng(seed)

    def states():
        for first in range(0, reps, BLOCK):
            yield first, pickle.dumps(rng.bit_generator.state)
            rng.integers(0, groups, size=(min(BLOCK, reps - first), groups))

    def draw(state: bytes, n: int) -> list[list[int]]:
        mine = np.random.default_rng()
        mine.bit_generator.state = pickle.loads(state)
        return mine.integers(0, groups, size=(n, groups)).tolist()

    return _replayed(spark, list(states()), draw, reps)


def _replayed(spark: SparkSession, states: list[tuple[int, bytes]], draw, reps: int) -> DataFrame:
    """Draws of all blocks, made where they are summed: what the driver sends is a generator's state a block."""
    block = BLOCK

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, state in zip(batch.column("first").to_pylist(), batch.column("state").to_pylist(), strict=True):
                found = [(first + k, np.bincount(drawn)) for k, drawn in enumerate(draw(state, min(block, reps - first))) if drawn]
                for rep, times in found:
                    ords = np.flatnonzero(times)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ords), rep), pa.int32()), pa.array(ords, pa.int32()), pa.array(times[ords], pa.int32())], names=["rep", "ord", "times"])

    sent = spark.createDataFrame(states, "first int, state binary").repartition(min(len(states), int(spark.conf.get("spark.sql.shuffle.partitions"))), "first")
    return sent.mapInArrow(replay, DRAWS)


def numbered(parts: DataFrame, group: str, *by: str) -> DataFrame:
    """(by, ord, num, den) of a row a group (in each by), groups in their order."""
    order = F.row_number().over(Window.partitionBy(*by).orderBy(group) if by else Window.orderBy(group)) - 1
    return parts.select(*by, order.alias("ord"), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))


def interval(contributions: DataFrame, draws: DataFrame, reps: int, linear: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, low, high, defined), one row (for each by), from contributions (by, ord, num, den): 2.5 and 97.5 % of the repetitions'
    ratios. The same draws serve all.

    Repetitions with a zero denominator are left out; with fewer than a tenth defined the bounds are null. Bounds are
    elements of the sorted ratios at int(q * m), or linear interpolation between them."""
    sums = draws.join(F.broadcast(contributions), "ord").groupBy(*by, "rep").agg(F.sum(F.col("num") * F.col("times")).alias("n"), F.sum(F.col("den") * F.col("times")).alias("d"))
    values = sums.select(*by, ratio(F.col("n"), F.col("d")).alias("v")).where("v is not null").groupBy(*by)
    if linear:
        return values.agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.count("*").alias("defined"))
    kept = values.agg(F.sort_array(F.collect_list("v")).alias("v"), F.count("*").alias("defined"))  # one value a repetition
    enough = F.col("defined") >= max(1, reps // 10)
    low = F.floor(F.lit(0.025) * F.col("defined")).cast("int")
    high = F.least(F.floor(F.lit(0.975) * F.col("defined")).cast("int"), (F.col("defined") - 1).cast("int"))
    return kept.select(*by, F.when(enough, F.get("v", low)).alias("low"), F.when(enough, F.get("v", high)).alias("high"), "defined")
