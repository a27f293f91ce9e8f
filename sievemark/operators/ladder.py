"""Ordered measurements of one item: steps, gate changes, bins and rank statistics.

A ladder has few rungs; windows are per ladder. Rank statistics over all rows sum ranks by distinct score first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import is_finite, ratio
from .calibrate import ranged
from .quantiles import exact_quantiles

#: Reporting cap, tolerance of a step, and the margin bins with their names.
CAP, STEP_TOLERANCE = -2.0, 1e-12
EDGES = (-2.0, -1.0, -0.5, -0.15, -0.05, 0.05, 0.15)
NAMES = ("(-2,-1)", "[-1,-0.5)", "[-0.5,-0.15)", "[-0.15,-0.05)", "[-0.05,0.05)", "[0.05,0.15)", "[0.15,+inf)")
CENSORED = "<=-2 (left censored)"


def prepare(rungs: DataFrame, tau: float) -> DataFrame:
    """rungs with flags; values out of contract stop the job when they are read."""
    if not 0 <= tau <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    bad = (
        F.when(~(is_finite(F.col("margin_mm")) & is_finite(F.col("p_yes"))), "non-finite value").when(~F.col("p_yes").between(0, 1), "p_yes out of range")
        .when(~F.col("label").isin("compatible", "incompatible", "ambiguous"), "unknown label").when(F.col("margin_mm") < CAP, "margin below the cap")
    )
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("double")).otherwise(F.col("margin_mm"))
    censored = F.col("margin_mm") == CAP
    return rungs.withColumn("margin_mm", checked).withColumns({
        "censored": censored.cast("int"), "relation": F.when(censored, "<=").otherwise("="), "eligible": (F.col("label") != "ambiguous").cast("int"),
        "accept_tau": (F.col("p_yes") >= tau).cast("int"), "accept_yes": (F.col("answer") == "yes").cast("int"),
    })


def steps(prepared: DataFrame) -> DataFrame:
    """One row per pair of neighbouring rungs: kind is rise, fall, tie or unresolved; gate is the change, if any."""
    w = Window.partitionBy("peg_id").orderBy("offset_mm")
    last = F.lag(F.struct("offset_mm", "margin_mm", "relation", "censored", "p_yes", "accept_tau")).over(w)
    rows = prepared.withColumn("low", last).where("low is not null")
    delta = F.col("p_yes") - F.col("low.p_yes")
    open_ = (F.col("low.censored") == 1) | (F.col("censored") == 1) | (F.col("margin_mm") <= F.col("low.margin_mm"))
    kind = F.when(open_, "unresolved").when(delta > STEP_TOLERANCE, "rise").when(delta < -STEP_TOLERANCE, "fall").otherwise("tie")
    gate = F.when(F.col("accept_tau") != F.col("low.accept_tau"), F.when(F.col("accept_tau") == 1, "reject_to_accept").otherwise("accept_to_reject"))
    return rows.select(
        "split", "family", "peg_id", F.col("low.offset_mm").alias("from_offset"), F.col("offset_mm").alias("to_offset"), F.col("low.margin_mm").alias("from_margin"),
        F.col("low.relation").alias("from_relation"), F.col("margin_mm").alias("to_margin"), F.col("relation").alias("to_relation"), kind.alias("kind"), gate.alias("gate"),
    )


def responses(prepared: DataFrame) -> DataFrame:
    """One row per peg: how its gate and score respond along the ladder."""
    base = prepared.groupBy("peg_id").agg(F.count("*").alias("n"), F.sum("accept_tau").alias("accepted"), F.sum("censored").alias("n_censored"), F.min("p_yes").alias("min_p"), F.max("p_yes").alias("max_p"))
    s = steps(prepared).groupBy("peg_id").agg(
        F.count("gate").alias("transitions"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("rise", "fall", "tie", "unresolved")]
    )
    out = base.join(s, "peg_id", "left").na.fill(0)
    kind = F.when(F.col("accepted") == F.col("n"), "always_accepts").when(F.col("accepted") == 0, "always_rejects").when(F.col("transitions") == 1, "one_observed_transition").otherwise("multiple_observed_transitions")
    return out.withColumns({"response": kind, "nonmonotonic": ((F.col("rise") > 0) & (F.col("fall") > 0)).cast("int")})


def bin_name():
    out = F.when(F.col("censored") == 1, CENSORED)
    for high, name in zip(EDGES[1:], NAMES, strict=False):
        out = out.when(F.col("margin_mm") < high, name)
    return out.otherwise(NAMES[-1])


def bins(prepared: DataFrame) -> DataFrame:
    """Per split and margin bin; margins are null where censored, as they are bounds there."""
    known = F.when(F.col("censored") == 0, F.col("margin_mm"))
    label = lambda x: F.count_if(F.col("label") == x).alias(f"n_{x}")
    by = ["split", "margin_bin"]
    prepared = prepared.withColumn("margin_bin", bin_name())
    out = prepared.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("family").alias("n_families"), F.count_distinct("peg_id").alias("n_pegs"), *map(label, ("compatible", "incompatible", "ambiguous")),
        F.sum("censored").alias("n_censored"), F.round(F.avg(known), 9).alias("mean_margin"), F.min(known).alias("min_margin"), F.max(known).alias("max_margin"),
        F.min("p_yes").alias("p_min"), F.max("p_yes").alias("p_max"),
        F.sum("accept_tau").alias("accepted"), F.round(F.avg("accept_tau"), 9).alias("accept_rate"), F.sum("image_fits").alias("image_fits"), F.round(F.avg("image_fits"), 9).alias("image_rate"),
    )
    quartiles = exact_quantiles(prepared, by, "p_yes", [0.25, 0.5, 0.75])
    names = {n: F.round(F.get("quantiles", F.lit(i)), 9) for i, n in enumerate(("p_q25", "p_median", "p_q75"))}
    return out.join(quartiles, by).withColumns(names).drop("quantiles")


def auroc(rows: DataFrame, by: str, score: str, positive, large: bool = False) -> DataFrame:
    """Area under the ROC curve per group, ties one half; null with one class only. Ranks are of distinct scores. large: groups
    may have any number of scores, of which only those of a range are ordered together (else: those of a group)."""
    at = rows.groupBy(by, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    before = lambda order, *part: F.coalesce(F.sum("neg").over(Window.partitionBy(by, *part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if large:
        at = ranged(at, score)
        starts = at.groupBy(by, "bucket").agg(F.sum("neg").alias("neg")).select(by, "bucket", before("bucket").alias("start"))
        at = at.join(starts, [by, "bucket"])
        below = before(score, "bucket") + F.col("start")
    else:
        below = before(score)
    wins = at.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    out = wins.groupBy(by).agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(by, ratio(F.col("w"), F.col("p") * F.col("n")).alias("auroc"))


def auroc_within(rows: DataFrame, by: str, block: str, score: str, positive) -> DataFrame:
    """As auroc(), of the pairs that lie in one block; a block is of one group and has few scores. One pass over rows by block."""
    at = rows.groupBy(block, score).agg(F.first(by).alias(by), F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(block).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = at.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    each = wins.groupBy(block).agg(F.first(by).alias(by), F.sum("wins").alias("w"), (F.sum("pos") * F.sum("neg")).alias("pairs"))
    return each.groupBy(by).agg(ratio(F.sum("w"), F.sum("pairs")).alias("auroc"))


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rank correlation per group; null where a side does not vary."""
    mean_rank = lambda c: F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2
    r = rows.select(by, mean_rank(x).alias("a"), mean_rank(y).alias("b"))
    s = r.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in (("sa", "a"), ("sb", "b"), ("saa", "a*a"), ("sbb", "b*b"), ("sab", "a*b"))])
    spread = F.sqrt((F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")) * (F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")))
    return s.select(by, ratio(F.col("n") * F.col("sab") - F.col("sa") * F.col("sb"), spread).alias("rho"))


def family_rate(prepared: DataFrame, label: str, value: str = "accept_tau") -> DataFrame:
    """Ratio of sums over families of hits and labelled rows, each as a share of the family's rows."""
    chosen = F.col("label") == label
    fam = prepared.groupBy("split", "family").agg(F.count("*").alias("rows"), F.count_if(chosen).alias("n"), F.sum(F.when(chosen, F.col(value)).otherwise(0)).alias("hits"))
    return fam.groupBy("split").agg(
        F.sum("hits").alias("accepted"), F.sum("n").alias("n"), ratio(F.sum("hits"), F.sum("n")).alias("raw_rate"),
        ratio(F.sum(F.col("hits") / F.col("rows")), F.sum(F.col("n") / F.col("rows"))).alias("balanced_rate"), F.count("*").alias("n_families"),
    )
