"""Ladders of measurements and rank statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bootstrap, ladder, quantiles
from ..sources import adapters as A
from . import query

TAU = 0.5
_PREP = A.SQL + f""", prep AS (SELECT *, (margin_mm = -2)::INTEGER AS censored, CASE WHEN margin_mm = -2 THEN '<=' ELSE '=' END AS relation, (label <> 'ambiguous')::INTEGER AS eligible,
 (p_yes >= {TAU}::DOUBLE)::INTEGER AS accept_tau, (answer = 'yes')::INTEGER AS accept_yes FROM ladder)"""
_STEPS = _PREP + """, pair AS (SELECT h.split, h.family, h.peg_id, l.offset_mm AS from_offset, h.offset_mm AS to_offset, l.margin_mm AS from_margin, l.relation AS from_relation, h.margin_mm AS to_margin, h.relation AS to_relation,
 CASE WHEN l.censored + h.censored > 0 OR h.margin_mm <= l.margin_mm THEN 'unresolved' WHEN h.p_yes - l.p_yes > 1e-12 THEN 'rise' WHEN h.p_yes - l.p_yes < -1e-12 THEN 'fall' ELSE 'tie' END AS kind,
 CASE WHEN l.accept_tau < h.accept_tau THEN 'reject_to_accept' WHEN l.accept_tau > h.accept_tau THEN 'accept_to_reject' END AS gate FROM prep l JOIN prep h ON l.peg_id = h.peg_id AND h.offset_mm = l.offset_mm + 1)"""


def prepared(spark, sf_dir):
    return ladder.prepare(A.ladder(spark, sf_dir), TAU)


@query("ladder_prepare", _PREP + "SELECT * FROM prep")
def ladder_prepare(spark, sf_dir):
    return prepared(spark, sf_dir)


@query("ladder_steps", _STEPS + "SELECT peg_id, from_offset, to_offset, kind FROM pair")
def ladder_steps(spark, sf_dir):
    return ladder.steps(prepared(spark, sf_dir)).select("peg_id", "from_offset", "to_offset", "kind")


@query("gate_transitions", _STEPS + "SELECT * EXCLUDE (kind) FROM pair WHERE gate IS NOT NULL")
def gate_transitions(spark, sf_dir):
    return ladder.steps(prepared(spark, sf_dir)).where("gate is not null").drop("kind")


@query("gate_class", _STEPS + """, t AS (SELECT peg_id, count(gate) AS transitions, count(*) FILTER (kind = 'rise') AS rise, count(*) FILTER (kind = 'fall') AS fall, count(*) FILTER (kind = 'tie') AS tie, count(*) FILTER (kind = 'unresolved') AS unresolved FROM pair GROUP BY peg_id)
SELECT peg_id, any_value(CASE WHEN lo = 1 THEN 'always_accepts' WHEN hi = 0 THEN 'always_rejects' WHEN transitions = 1 THEN 'one_observed_transition' ELSE 'multiple_observed_transitions' END) AS response, any_value(transitions) AS transitions, any_value(rise) AS rise, any_value(fall) AS fall, any_value(tie) AS tie, any_value(unresolved) AS unresolved
FROM (SELECT peg_id, min(accept_tau) AS lo, max(accept_tau) AS hi FROM prep GROUP BY peg_id) JOIN t USING (peg_id) GROUP BY peg_id""")
def gate_class(spark, sf_dir):
    return ladder.responses(prepared(spark, sf_dir)).select("peg_id", "response", "transitions", "rise", "fall", "tie", "unresolved")


_BIN = "CASE WHEN censored = 1 THEN '<=-2 (left censored)' " + " ".join(f"WHEN margin_mm < {e}::DOUBLE THEN '{n}'" for e, n in zip(ladder.EDGES[1:], ladder.NAMES, strict=False)) + f" ELSE '{ladder.NAMES[-1]}' END"


@query("margin_bins", _PREP + f"""SELECT split, {_BIN} AS margin_bin, count(*) AS n, count(DISTINCT family) AS n_families, count(DISTINCT peg_id) AS n_pegs, count(*) FILTER (label = 'compatible') AS n_compatible, count(*) FILTER (label = 'incompatible') AS n_incompatible,
 count(*) FILTER (label = 'ambiguous') AS n_ambiguous, sum(censored)::BIGINT AS n_censored, round(avg(margin_mm) FILTER (censored = 0), 9) AS mean_margin, min(margin_mm) FILTER (censored = 0) AS min_margin, max(margin_mm) FILTER (censored = 0) AS max_margin,
 min(p_yes) AS p_min, round(quantile_cont(p_yes, 0.25), 9) AS p_q25, round(quantile_cont(p_yes, 0.5), 9) AS p_median, round(quantile_cont(p_yes, 0.75), 9) AS p_q75, max(p_yes) AS p_max,
 sum(accept_tau)::BIGINT AS accepted, round(avg(accept_tau), 9) AS accept_rate, sum(image_fits)::BIGINT AS image_fits, round(avg(image_fits), 9) AS image_rate FROM prep GROUP BY ALL""")
def margin_bins(spark, sf_dir):
    return ladder.bins(prepared(spark, sf_dir))


_BANDS = _PREP + """, e AS (SELECT family, list_distinct([quantile_cont(margin_mm, 0.1), quantile_cont(margin_mm, 0.5), quantile_cont(margin_mm, 0.9)]) AS p FROM prep WHERE split = 'calib' GROUP BY family)"""


@query("margin_quantiles", _PREP + "SELECT family, round(quantile_cont(margin_mm, 0.025), 9) AS low, round(quantile_cont(margin_mm, 0.5), 9) AS median, round(quantile_cont(margin_mm, 0.975), 9) AS high FROM prep GROUP BY family")
def margin_quantiles(spark, sf_dir):
    """Quantiles of the margins of each family, exact."""
    found = quantiles.exact_quantiles(prepared(spark, sf_dir), ["family"], "margin_mm", [0.025, 0.5, 0.975])
    return found.select("family", *(F.round(F.get("quantiles", F.lit(k)), 9).alias(n) for k, n in enumerate(("low", "median", "high"))))


@query("margin_bands", _BANDS + """, r AS (SELECT family, split, len(list_filter(p, lambda c: c <= margin_mm))::INTEGER AS band, p_yes FROM prep JOIN e USING (family)) SELECT family, split, band, count(*) AS n, max(p_yes) AS p_max FROM r GROUP BY ALL""")
def margin_bands(spark, sf_dir):
    """Rungs by the bands of their family's margins, whose edges are a table fitted on calib: a range join."""
    rows = prepared(spark, sf_dir)
    edges = quantiles.exact_quantiles(rows.where("split = 'calib'"), ["family"], "margin_mm", [0.1, 0.5, 0.9])
    met = quantiles.in_ranges(rows.select("family", "split", "margin_mm", "p_yes"), "margin_mm", quantiles.bands(edges, ["family"], "quantiles"), ["family"])
    return met.groupBy("family", "split", "band").agg(F.count("*").alias("n"), F.max("p_yes").alias("p_max"))


@query("family_rate", _PREP + """, f AS (SELECT split, family, count(*) AS rows_, count(*) FILTER (label = 'compatible') AS n, coalesce(sum(accept_tau) FILTER (label = 'compatible'), 0)::BIGINT AS hits FROM prep GROUP BY ALL)
SELECT split, sum(hits)::BIGINT AS accepted, sum(n)::BIGINT AS n, round(sum(hits) / sum(n), 9) AS raw_rate, round(sum(hits / rows_) / sum(n / rows_), 9) AS balanced_rate, count(*) AS n_families FROM f GROUP BY split""")
def family_rate(spark, sf_dir):
    return ladder.family_rate(prepared(spark, sf_dir), "compatible").withColumns({c: F.round(c, 9) for c in ("raw_rate", "balanced_rate")})


@query("auroc", _PREP + """SELECT p.split, round(sum(CASE WHEN p.p_yes > n.p_yes THEN p.c * n.c WHEN p.p_yes = n.p_yes THEN p.c * n.c / 2 ELSE 0 END) / sum(p.c * n.c), 9) AS auroc
FROM (SELECT split, p_yes, count(*) AS c FROM prep WHERE label = 'compatible' GROUP BY ALL) p JOIN (SELECT split, p_yes, count(*) AS c FROM prep WHERE label = 'incompatible' GROUP BY ALL) n ON p.split = n.split GROUP BY p.split""")
def auroc(spark, sf_dir):
    rows = prepared(spark, sf_dir).where("eligible = 1")
    return ladder.auroc(rows, "split", "p_yes", F.col("label") == "compatible", large=True).select("split", F.round("auroc", 9).alias("auroc"))


@query("spearman", _PREP + """, k AS (SELECT peg_id, rank() OVER (PARTITION BY peg_id ORDER BY offset_mm) + (count(*) OVER (PARTITION BY peg_id, offset_mm) - 1) / 2 AS a, rank() OVER (PARTITION BY peg_id ORDER BY p_yes) + (count(*) OVER (PARTITION BY peg_id, p_yes) - 1) / 2 AS b FROM prep)
SELECT peg_id, round(corr(a, b), 8) AS rho FROM k GROUP BY peg_id""")
def spearman(spark, sf_dir):
    return ladder.spearman(prepared(spark, sf_dir), "peg_id", "offset_mm", "p_yes").select("peg_id", F.round("rho", 8).alias("rho"))


@query("spearman_summary", _PREP + """, k AS (SELECT peg_id, rank() OVER (PARTITION BY peg_id ORDER BY offset_mm) + (count(*) OVER (PARTITION BY peg_id, offset_mm) - 1) / 2 AS a, rank() OVER (PARTITION BY peg_id ORDER BY p_yes) + (count(*) OVER (PARTITION BY peg_id, p_yes) - 1) / 2 AS b FROM prep),
r AS (SELECT corr(a, b) AS rho FROM k GROUP BY peg_id) SELECT count(rho) AS n, round(median(rho), 8) AS median_rho, round(count(*) FILTER (rho > 0) / count(rho), 9) AS share_positive FROM r""")
def spearman_summary(spark, sf_dir):
    """Median rank correlation of all ladders that have one, and how many are positive."""
    rho = ladder.spearman(prepared(spark, sf_dir), "peg_id", "offset_mm", "p_yes").where("rho is not null")
    return rho.agg(F.count("*").alias("n"), F.round(F.median("rho"), 8).alias("median_rho"), F.round(F.count_if(F.col("rho") > 0) / F.count("*"), 9).alias("share_positive"))


@query("label_hist", A.SQL + "SELECT label, answer, count(*) AS n FROM ladder GROUP BY ALL")
def label_hist(spark, sf_dir):
    return A.ladder(spark, sf_dir).groupBy("label", "answer").agg(F.count("*").alias("n"))


@query("label_category", A.SQL + "SELECT peg_id, offset_mm, CASE WHEN label <> 'ambiguous' THEN label || CASE WHEN margin_mm = -2 THEN ' (capped)' WHEN margin_mm > 1.5::DOUBLE THEN ' (loose)' ELSE '' END ELSE 'ambiguous' END AS category FROM ladder")
def label_category(spark, sf_dir):
    """Five kinds of label for display."""
    m = F.col("margin_mm")
    kind = (
        F.when(F.col("label") == "ambiguous", "ambiguous").when(m == -2, "incompatible (capped)").when(m > 1.5, "compatible (loose)").otherwise(F.col("label"))
    )
    return A.ladder(spark, sf_dir).select("peg_id", "offset_mm", kind.alias("category"))


@query("rung_summary", A.SQL + "SELECT split, offset_mm, count(*) AS n, count(*) FILTER (label = 'compatible') AS compatible, count(*) FILTER (label = 'incompatible') AS incompatible, count(*) FILTER (label = 'ambiguous') AS ambiguous, round(avg(p_yes), 9) AS mean_p, round(avg(margin_mm), 9) AS mean_margin FROM ladder GROUP BY ALL")
def rung_summary(spark, sf_dir):
    rows = A.ladder(spark, sf_dir)
    label = [F.count_if(F.col("label") == x).alias(x) for x in ("compatible", "incompatible", "ambiguous")]
    return rows.groupBy("split", "offset_mm").agg(F.count("*").alias("n"), *label, F.round(F.avg("p_yes"), 9).alias("mean_p"), F.round(F.avg("margin_mm"), 9).alias("mean_margin"))


@query("control_agreement", A.SQL + """SELECT split, count(*) FILTER (label <> 'ambiguous') AS n, count(*) FILTER (label <> 'ambiguous' AND (image_fits = 1) = (label = 'compatible')) AS agree,
 round(avg(abs(margin_mm - p_yes)) FILTER (abs(margin_mm) <= 0.5), 9) AS mean_error, max(abs(margin_mm - p_yes)) FILTER (abs(margin_mm) <= 0.5) AS worst FROM ladder GROUP BY split""")
def control_agreement(spark, sf_dir):
    """How often a second measurement agrees, and its error near the boundary."""
    sure = F.col("label") != "ambiguous"
    error = F.when(F.abs("margin_mm") <= 0.5, F.abs(F.col("margin_mm") - F.col("p_yes")))
    agree = (F.col("image_fits") == 1) == (F.col("label") == "compatible")
    return A.ladder(spark, sf_dir).groupBy("split").agg(F.count_if(sure).alias("n"), F.count_if(sure & agree).alias("agree"), F.round(F.avg(error), 9).alias("mean_error"), F.max(error).alias("worst"))


@query("config_summary", A.SQL + """SELECT family, round(avg(p_yes) FILTER (label = 'compatible'), 9) AS mean_compatible, round(avg(p_yes) FILTER (label = 'incompatible'), 9) AS mean_incompatible, round(avg((answer = 'yes')::INT), 9) AS yes_rate,
 round(avg(((answer = 'yes') = (label = 'compatible'))::INT) FILTER (label <> 'ambiguous'), 9) AS accuracy, round(avg((answer = 'no')::INT) FILTER (margin_mm = -2), 9) AS acc_capped, min(p_yes) AS least FROM ladder GROUP BY family""")
def config_summary(spark, sf_dir):
    """One row per configuration: accuracy, yes rate and means by class."""
    right = ((F.col("answer") == "yes") == (F.col("label") == "compatible")).cast("int")
    part = lambda c, x: F.avg(F.when(c, x))
    label = F.col("label")
    out = A.ladder(spark, sf_dir).groupBy("family").agg(
        part(label == "compatible", F.col("p_yes")).alias("mean_compatible"), part(label == "incompatible", F.col("p_yes")).alias("mean_incompatible"), F.avg((F.col("answer") == "yes").cast("int")).alias("yes_rate"),
        part(label != "ambiguous", right).alias("accuracy"), part(F.col("margin_mm") == -2, (F.col("answer") == "no").cast("int")).alias("acc_capped"), F.min("p_yes").alias("least"),
    )
    return out.withColumns({c: F.round(c, 9) for c in out.columns[1:-1]})


@query("group_table", A.SQL + "SELECT split, label, count(*) AS n, round(count(*) FILTER (answer = 'yes') / count(*), 9) AS yes_rate, round(avg(p_yes), 9) AS mean_p FROM ladder GROUP BY ALL")
def group_table(spark, sf_dir):
    return A.ladder(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("answer") == "yes").cast("int")), 9).alias("yes_rate"), F.round(F.avg("p_yes"), 9).alias("mean_p"))


@query("same_peg_ranking", A.SQL + """SELECT c.peg_id, round(avg(CASE WHEN c.p_yes > i.p_yes THEN 1 WHEN c.p_yes = i.p_yes THEN 0.5 ELSE 0 END), 9) AS win_rate, count(*) AS pairs
FROM ladder c JOIN ladder i ON c.peg_id = i.peg_id AND c.label = 'compatible' AND i.label = 'incompatible' GROUP BY c.peg_id""")
def same_peg_ranking(spark, sf_dir):
    """How often a compatible score beats an incompatible one of the same peg; by ranks, without the pairs."""
    rows = A.ladder(spark, sf_dir).where("label <> 'ambiguous'")
    n = rows.groupBy("peg_id").agg((F.count_if(F.col("label") == "compatible") * F.count_if(F.col("label") == "incompatible")).alias("pairs"))
    rate = ladder.auroc(rows, "peg_id", "p_yes", F.col("label") == "compatible").where("auroc is not null")
    return rate.join(n, "peg_id").select("peg_id", F.round("auroc", 9).alias("win_rate"), "pairs")


@query("unique_offset", A.SQL + "SELECT peg_id, CASE WHEN peg_id % 5 = 0 THEN offset_mm - offset_mm % 2 ELSE offset_mm END AS offset_mm, count(*) AS n FROM ladder GROUP BY ALL HAVING count(*) > 1")
def unique_offset(spark, sf_dir):
    """Rungs that a ladder has twice, when some ladders are read at every other rung."""
    rung = F.when(F.col("peg_id") % 5 == 0, F.col("offset_mm") - F.col("offset_mm") % 2).otherwise(F.col("offset_mm"))
    return A.ladder(spark, sf_dir).withColumn("offset_mm", rung).groupBy("peg_id", "offset_mm").agg(F.count("*").alias("n")).where("n > 1")


@query("first_of_family", A.SQL + "SELECT peg_id, family, peg_id = min(peg_id) OVER (PARTITION BY family) AS first FROM (SELECT DISTINCT peg_id, family FROM ladder)")
def first_of_family(spark, sf_dir):
    """Where a list sorted by family and id starts a new family."""
    pegs = A.ladder(spark, sf_dir).select("peg_id", "family").distinct()
    last = F.lag("family").over(Window.partitionBy("family").orderBy("peg_id"))
    return pegs.select("peg_id", "family", last.isNull().alias("first"))


@query("bootstrap_ladder")
def bootstrap_ladder(spark, sf_dir):
    rows = prepared(spark, sf_dir).where("split = 'calib'")
    hit = (F.col("label") == "compatible").cast("int")
    fam = rows.groupBy("family").agg((F.sum(hit * F.col("accept_tau")) / F.count("*")).alias("num"), (F.sum(hit) / F.count("*")).alias("den"))
    parts = bootstrap.numbered(fam, "family")
    return bootstrap.interval(parts, bootstrap.draws_by_integers(spark, parts.count()), bootstrap.REPS, linear=True)
