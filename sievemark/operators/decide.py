"""Selection rules: one aggregation per block gives all that any rule needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import fault

METHODS = ("B0", "B1", "U0", "S1", "S2")


def with_fault(scores: DataFrame) -> DataFrame:
    return scores.withColumn("fault", fault(*(F.col(c) for c in ("answer", "top_prob", "p_yes", "mass_yes", "mass_no"))))


def composite_order() -> list[Column]:
    """Yes answers by falling probability of the answer, then the others by rising; ties by id."""
    yes = F.col("answer") == "yes"
    return [F.when(yes, 0).otherwise(1), F.when(yes, -F.col("top_prob")).otherwise(F.col("top_prob")), F.col("cand_id")]


def summarise_blocks(labelled: DataFrame, *keep: str) -> DataFrame:
    """One row per block_id: its first fault, the best candidates by each order, and their labels."""
    best = F.struct(-F.col("p_yes"), F.col("cand_id"))
    who = F.struct("cand_id", "label", "p_yes")
    yes = F.col("answer") == "yes"
    top2 = F.slice(F.sort_array(F.collect_list("p_yes"), asc=False), 1, 2)  # a block has few candidates
    out = with_fault(labelled).groupBy("block_id", *keep).agg(
        F.count("*").alias("n_candidates"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position"))).alias("fault"),
        F.bool_or(F.col("label") == "compatible").alias("has_compatible"), F.count_if(yes).alias("n_yes"),
        F.min_by(who, best).alias("u0"), F.min_by(who, F.struct(*composite_order())).alias("b0"), F.min_by(who, F.when(yes, F.col("position"))).alias("b1"), top2.alias("top2"),
    )
    margin = F.when(F.size("top2") > 1, F.get("top2", F.lit(0)) - F.get("top2", F.lit(1))).otherwise(0.0)
    return out.withColumns({"best_p": F.col("u0.p_yes"), "margin": margin}).drop("top2")


def _decision(method: str, tau: Column | float | None, delta: Column | float | None) -> dict[str, Column]:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method in ("S1", "S2") and tau is None or method == "S2" and delta is None:
        raise ValueError(f"{method} lacks a threshold")
    accept = {"B0": F.lit(True), "B1": F.col("n_yes") == 1, "U0": F.lit(True)}
    if tau is not None:
        accept["S1"] = F.col("best_p") >= tau
        if delta is not None:
            accept["S2"] = accept["S1"] & (F.col("margin") >= delta)
    pick = F.col({"B0": "b0", "B1": "b1"}.get(method, "u0"))
    valid, right = F.col("fault").isNull(), pick["label"] == "compatible"
    chosen = valid & accept[method]
    return {
        "method": F.lit(method), "status": F.when(~valid, "model_failure").when(chosen, "select").otherwise("defer"), "selected": F.when(chosen, pick["cand_id"]),
        "outcome": F.when(~valid, "failure").when(~chosen, "defer").when(right, "correct").otherwise("wrong"),
        "top1": F.lit(None).cast("boolean") if method == "B1" else F.col("has_compatible") & valid & right,
    }


def decide(blocks: DataFrame, method: str, tau: Column | float | None = None, delta: Column | float | None = None) -> DataFrame:
    """blocks with method, status (select, defer, model_failure), selected, outcome and top1.

    Thresholds are inclusive. top1 is whether the ungated best is compatible; null for B1, which ranks nothing."""
    return blocks.withColumns(_decision(method, tau, delta))


def decide_all(blocks: DataFrame, tau: Column | float, delta: Column | float, *keep: str) -> DataFrame:
    """The kept columns of blocks and what decide() adds, for every method: blocks are read once."""
    each = [F.struct(*(c.alias(k) for k, c in _decision(m, tau, delta).items())) for m in METHODS]
    return blocks.select(*keep, F.explode(F.array(*each)).alias("d")).select(*keep, "d.*")
