"""Counts, balanced weights and ratios over overlapping slices.

Rows are counted once per (family, regime) cell; weights depend only on the cells of a slice, so slices and weights
are worked out on that small table and never shuffle rows again.
"""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_sums
from ..functions.scores import ratio
from .decide import decide_all

#: Names of the reported counts, and of the ratios with their two counts.
COUNTS = ("n", "n_present", "n_absent", "selected", "correct", "wrong", "deferred", "failures", "present_selected", "absent_selected", "top1_correct")
RATIOS = {
    "coverage": ("selected", "n"), "present_coverage": ("present_selected", "n_present"), "accepted_risk": ("wrong", "selected"), "correct_yield": ("correct", "n_present"),
    "absent_false_accept": ("absent_selected", "n_absent"), "failure_rate": ("failures", "n"), "top1_present": ("top1_correct", "n_present"),
}


def counts() -> dict[str, Column]:
    picked, present = F.col("outcome").isin("correct", "wrong"), F.col("has_compatible")
    when = {
        "n": F.lit(True), "n_present": present, "n_absent": ~present, "selected": picked, "correct": F.col("outcome") == "correct", "wrong": F.col("outcome") == "wrong",
        "deferred": F.col("outcome") == "defer", "failures": F.col("outcome") == "failure", "present_selected": present & picked, "absent_selected": ~present & picked,
        "top1_correct": present & F.coalesce("top1", F.lit(False)),
    }
    return {k: F.count_if(c).alias(k) for k, c in when.items()}


def cells(decided: DataFrame) -> DataFrame:
    """Counts per method, family, tier and regime: all that reports need."""
    return decided.groupBy("method", "family", "tier", "regime").agg(*counts().values())


def all_methods(blocks: DataFrame, tau: float, delta: float) -> DataFrame:
    """Cells of all methods from one pass over blocks."""
    return cells(decide_all(blocks, tau, delta, "family", "tier", "regime", "has_compatible"))


def with_weights(cell: DataFrame, *by: str, regime_weights: dict[str, float] | None = None, weighting: str = "family") -> DataFrame:
    """Cells with weight: each family of a slice (by) counts alike, so do its regimes, so do a regime's rows."""
    if weighting == "query" or weighting == "family":
        unfit = {k: x for k, x in (regime_weights or {}).items() if not (isfinite(x) and x >= 0)}
    else:
        raise ValueError(f"no such weighting: {weighting}")
    if unfit:
        raise ValueError(f"weights of regimes must be numbers from 0 up: {unfit}")
    w = F.lit(1.0)
    if regime_weights:
        w = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in regime_weights.items() for x in kv]), lambda k, _: k == F.col("regime"))), F.lit(0)), F.lit(1.0))
    if weighting == "query":
        return cell.withColumn("weight", w)
    regimes = F.size(F.collect_set("regime").over(Window.partitionBy(*by, "family")))  # of few cells
    rows = F.sum("n").over(Window.partitionBy(*by, "family", "regime"))
    return cell.withColumn("weight", w / (regimes * rows))


def report(cell: DataFrame, *by: str, digits: int = 9, **kw) -> DataFrame:
    """Raw counts, weighted counts and ratios of the latter for each slice; by must include method. Weights are summed
    exactly, each as often as the cell counts it, and rounded once."""
    families = F.size(F.collect_set("family").over(Window.partitionBy(*by))).cast("long")  # of few cells
    cell = with_weights(cell, *by, **kw).withColumn("n_families", families)
    sums = {f"weighted_{c}": (F.col("weight"), F.col(c)) for c in COUNTS} | {c: (F.lit(1.0), F.col(c)) for c in COUNTS}
    out = exact_sums(cell, [*by, "n_families"], sums)  # all in one pass over the cells
    out = out.select(*by, "n_families", *(F.col(c).cast("long").alias(c) for c in COUNTS), *(f"weighted_{c}" for c in COUNTS))
    ratios = {k: ratio(F.col(f"weighted_{a}"), F.col(f"weighted_{b}")) for k, (a, b) in RATIOS.items()}
    out = out.withColumns(ratios)
    ranked = {c: F.when(F.col("method") != "B1", F.col(c)) for c in ("top1_correct", "weighted_top1_correct", "top1_present")}
    out = out.withColumns(ranked)
    return out.withColumns({c: F.round(c, digits) for c in [f"weighted_{c}" for c in COUNTS] + list(RATIOS)})


def sliced(cell: DataFrame, exposed: tuple[str, ...]) -> DataFrame:
    """Cells once for each slice that they belong to: families x (tier, regime)."""
    families = F.array(F.lit("all"), F.when(F.col("family").isin(*exposed), "exposed").otherwise("unexposed"), F.concat(F.lit("family:"), F.col("family")))
    levels = F.array(
        F.struct(F.lit("all").alias("tier"), F.lit("all").alias("regime")), F.struct(F.col("tier"), F.lit("all").alias("regime")), F.struct(F.col("tier"), F.col("regime"))
    )
    out = cell.withColumn("families", F.explode(families)).withColumn("level", F.explode(levels))
    return out.withColumns({"slice_tier": F.col("level.tier"), "slice_regime": F.col("level.regime")}).drop("level")
