"""Thresholds fitted on one split and applied unchanged to another.

Sweeps over thresholds are running sums. Scores are first summed by BUCKETS ranges of about as many scores each; running sums
over that small table give each range its start, and only rows of one range are ever ordered together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ratio

#: The coverage target and the grids of thresholds.
TARGET, TOLERANCE = 0.70, 1e-12
TAUS = tuple(round(0.1 * i, 2) for i in range(11))
DELTAS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5)
BUCKETS = 512


def block_weights(blocks: DataFrame, weighting: str = "family") -> DataFrame:
    """blocks with weight: families alike, their regimes alike, rows of a regime alike. Families are few, so their weights are
    broadcast and blocks stay where they are: dealt by family, a task would hold a share of all blocks."""
    if weighting == "query":
        return blocks.withColumn("weight", F.lit(1.0))
    sizes = blocks.groupBy("family", "regime").agg(F.count("*").alias("rows"))
    regimes = sizes.groupBy("family").agg(F.count("*").alias("regimes"))
    cell = sizes.join(regimes, "family").select("family", "regime", (1.0 / (F.col("rows") * F.col("regimes"))).alias("weight"))
    return blocks.join(F.broadcast(cell), ["family", "regime"])


def curve(weighted: DataFrame, measures: dict) -> DataFrame:
    """(p, measures): for each best score p of a valid block, sums over blocks with best score >= p."""
    valid = weighted.where("fault is null").groupBy(F.col("best_p").alias("p")).agg(*[F.sum(v).alias(k) for k, v in measures.items()])
    valid = ranged(valid, "p")
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = valid.groupBy("bucket").agg(*[F.sum(k).alias(k) for k in measures]).select("bucket", *[F.coalesce(F.sum(k).over(above), F.lit(0.0)).alias(f"{k}_above") for k in measures])
    within = Window.partitionBy("bucket").orderBy(F.desc("p"))
    return valid.join(F.broadcast(starts), "bucket").select("p", *[(F.sum(k).over(within) + F.col(f"{k}_above")).alias(k) for k in measures])  # at most BUCKETS rows


def ranged(rows: DataFrame, score: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with bucket, which grows with the score: ranges that hold about as many rows each."""
    cuts = rows.agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("__cuts"))
    below = F.size(F.filter("__cuts", lambda c: c <= F.col(score)))
    return rows.join(F.broadcast(cuts)).withColumn("bucket", F.coalesce(below, F.lit(0))).drop("__cuts")  # one row


def s1_threshold(blocks: DataFrame, target: float = TARGET, weighting: str = "family") -> DataFrame:
    """One row: tau, the highest score at which the selected share of present blocks reaches the target; 0 if none."""
    w = block_weights(blocks, weighting)
    present = F.when(F.col("has_compatible"), F.col("weight")).otherwise(0.0)
    need = w.agg(F.sum(present).alias("need"))
    reached = curve(w, {"got": present}).join(F.broadcast(need)).where(F.col("got") >= (target - TOLERANCE) * F.col("need"))
    return reached.agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("tau"))


def s2_grid(blocks: DataFrame, s1_tau: DataFrame | float, taus: tuple[float, ...] = TAUS, deltas: tuple[float, ...] = DELTAS, weighting: str = "family") -> DataFrame:
    """Coverage, risk and yield for each setting of taus, s1_tau (a number, or one row with tau) and deltas. A block is counted
    once, by how many thresholds it passes; sums over the settings are taken on the table of those counts."""
    taus, deltas = sorted(taus), sorted(deltas)
    passed = lambda x, cuts: sum((F.when(F.col(x) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    w = _with_tau(block_weights(blocks, weighting), s1_tau)
    ok, right = F.col("fault").isNull(), F.col("u0.label") == "compatible"
    weight = F.col("weight")
    mark = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    more = (ok & (F.col("best_p") >= F.col("s1_tau"))).alias("s")
    cell = w.groupBy("s1_tau", more, F.when(ok, passed("best_p", taus)).otherwise(0).alias("i"), F.when(ok, passed("margin", deltas)).otherwise(0).alias("j")).agg(
        mark(ok).alias("sel"), mark(ok & F.col("has_compatible")).alias("got"), mark(ok & right).alias("correct"), mark(ok & ~right).alias("wrong"),
        mark(F.lit(True)).alias("all"), mark(F.col("has_compatible")).alias("present"),
    )
    # the setting with s1_tau has no place among the others; where it equals one of them it gives the same sums
    setting = lambda t, d, i, j: F.struct(t.alias("tau"), F.lit(d).alias("delta"), F.lit(i).cast("int").alias("ti"), F.lit(j + 1).alias("dj"))
    places = [*((F.lit(t), i + 1) for i, t in enumerate(taus)), (F.col("s1_tau"), None)]
    each = cell.withColumn("g", F.explode(F.array(*[setting(t, d, i, j) for t, i in places for j, d in enumerate(deltas)])))
    each = each.where(F.col("g.ti").isNotNull() | ~F.col("g.tau").isin(*taus))
    inside = F.when(F.col("g.ti").isNull(), F.col("s")).otherwise(F.col("i") >= F.col("g.ti")) & (F.col("j") >= F.col("g.dj"))
    over = lambda c: F.sum(F.when(inside, F.col(c)).otherwise(0.0))
    sums = each.groupBy("g.tau", "g.delta").agg(*[over(c).alias(c) for c in ("sel", "got", "correct", "wrong")], F.sum("all").alias("all"), F.sum("present").alias("present"))
    return sums.select(
        "tau", "delta", ratio(F.col("sel"), F.col("all")).alias("coverage"), ratio(F.col("got"), F.col("present")).alias("present_coverage"),
        ratio(F.col("wrong"), F.when(F.col("sel") > TOLERANCE, F.col("sel"))).alias("accepted_risk"), ratio(F.col("correct"), F.col("present")).alias("correct_yield"),
    )


def _with_tau(rows: DataFrame, tau: DataFrame | float) -> DataFrame:
    if isinstance(tau, DataFrame):
        return rows.join(F.broadcast(tau.select(F.col("tau").alias("s1_tau"))))  # one row
    return rows.withColumn("s1_tau", F.lit(float(tau)))


def s2_choice(grid: DataFrame, s1_tau: DataFrame | float, target: float = TARGET) -> DataFrame:
    """One row (tau, delta): least risk among settings that reach the target; ties by yield, tau, delta, the larger first."""
    order = F.struct(F.round("accepted_risk", 12), -F.round("correct_yield", 12), -F.col("tau"), -F.col("delta"))
    good = grid.where((F.col("present_coverage") >= target - TOLERANCE) & F.col("accepted_risk").isNotNull())
    best = good.agg(F.min_by(F.struct("tau", "delta"), order).alias("b"))
    return _with_tau(best, s1_tau).select(F.coalesce("b.tau", "s1_tau").alias("tau"), F.coalesce("b.delta", F.lit(0.0)).alias("delta"))


def risk_coverage(blocks: DataFrame, weighting: str = "family") -> DataFrame:
    """(tau, coverage, accepted_risk, correct_yield) at every best score of a valid block, and at 0 and 1."""
    w = block_weights(blocks, weighting)
    weight = F.col("weight")
    right = F.col("u0.label") == "compatible"
    measures = {"sel": weight, "correct": F.when(right, weight).otherwise(0.0), "wrong": F.when(right, 0.0).otherwise(weight)}
    totals = w.agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("has_compatible"), weight).otherwise(0.0)).alias("present"))
    points = curve(w, measures)
    end = points.agg(*[F.max(c).alias(c) for c in ("sel", "correct", "wrong")])
    at_one = w.where((F.col("best_p") >= 1) & F.col("fault").isNull()).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in measures.items()])
    both = points.unionByName(end.withColumn("p", F.lit(0.0))).unionByName(at_one.withColumn("p", F.lit(1.0))).dropDuplicates(["p"])
    return both.join(F.broadcast(totals)).select(
        F.col("p").alias("tau"), ratio(F.col("sel"), F.col("all")).alias("coverage"), ratio(F.col("wrong"), F.col("sel")).alias("accepted_risk"), ratio(F.col("correct"), F.col("present")).alias("correct_yield"),
    )


#: Fixed value: the share of right choices by guessing.
CHANCE = 1 / 3


def no_better_than_chance(lower_bounds: list[float | None], chance: float = CHANCE) -> bool:
    """Whether no selector's interval lies above chance; an undefined bound does not count."""
    return not any(x is not None and math.isfinite(x) and x > chance for x in lower_bounds)
