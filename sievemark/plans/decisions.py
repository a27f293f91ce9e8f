"""Decisions, evaluation, calibration and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.exact import exact_sums
from ..operators import bootstrap, calibrate, evaluate, ladder
from ..operators.decide import METHODS, composite_order, decide, summarise_blocks, with_fault
from ..sources import adapters as A
from . import query

TAU, DELTA = 0.8, 0.05
KEEP = ("family", "split", "tier", "regime")

FAULT = """, v AS (SELECT *, CASE WHEN mass_yes < 0 OR mass_no < 0 THEN 'negative mass' WHEN mass_yes + mass_no <= 0 OR mass_yes + mass_no > 1.000001::DOUBLE THEN 'mass out of range'
  WHEN top_prob < 0 OR top_prob > 1 THEN 'probability out of range' WHEN answer NOT IN ('yes', 'no') THEN 'neither yes nor no' END AS fault FROM lab),
r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY p_yes DESC, cand_id) AS ru, row_number() OVER (PARTITION BY block_id ORDER BY (answer <> 'yes'), CASE WHEN answer = 'yes' THEN -top_prob ELSE top_prob END, cand_id) AS rb FROM v),
b AS (SELECT block_id, any_value(family) AS family, any_value(split) AS split, any_value(tier) AS tier, any_value(regime) AS regime, bool_or(label = 'compatible') AS present, count(fault) > 0 AS bad,
  count(*) FILTER (answer = 'yes') AS n_yes, max(CASE WHEN ru = 1 THEN cand_id END) AS u0, max(CASE WHEN ru = 1 THEN label END) AS u0_label, max(p_yes) AS best_p,
  coalesce(max(p_yes) - max(CASE WHEN ru = 2 THEN p_yes END), 0) AS margin, max(CASE WHEN rb = 1 THEN cand_id END) AS b0, max(CASE WHEN rb = 1 THEN label END) AS b0_label,
  min(CASE WHEN answer = 'yes' THEN cand_id END) AS b1, arg_min(label, cand_id) FILTER (answer = 'yes') AS b1_label FROM r GROUP BY block_id)"""
_ACCEPT = {"B0": "true", "B1": "n_yes = 1", "U0": "true", "S1": f"best_p >= {TAU}::DOUBLE", "S2": f"best_p >= {TAU}::DOUBLE AND margin >= {DELTA}::DOUBLE"}


def _decided_sql(method: str, accept: str | None = None, name: str = "d") -> str:
    who = {"B0": "b0", "B1": "b1"}.get(method, "u0")
    top1 = "NULL::BOOLEAN" if method == "B1" else f"present AND NOT bad AND {who}_label = 'compatible'"
    accept = accept or _ACCEPT[method]
    return f""", {name} AS (SELECT *, '{method}' AS method, CASE WHEN bad THEN 'model_failure' WHEN {accept} THEN 'select' ELSE 'defer' END AS status, CASE WHEN NOT bad AND ({accept}) THEN {who} END AS selected,
  CASE WHEN bad THEN 'failure' WHEN NOT ({accept}) THEN 'defer' WHEN {who}_label = 'compatible' THEN 'correct' ELSE 'wrong' END AS outcome, {top1} AS top1 FROM b)"""


_CONDITIONS = {
    "n": "true", "n_present": "present", "n_absent": "NOT present", "selected": "outcome IN ('correct', 'wrong')", "correct": "outcome = 'correct'", "wrong": "outcome = 'wrong'", "deferred": "outcome = 'defer'",
    "failures": "outcome = 'failure'", "present_selected": "present AND outcome IN ('correct', 'wrong')", "absent_selected": "NOT present AND outcome IN ('correct', 'wrong')", "top1_correct": "present AND coalesce(top1, false)",
}


def _report_sql(rows: str, by: str) -> str:
    """Counts, weights and ratios from rows with one line per block and slice: weights by windows over the rows."""
    keep = lambda c, x: f"CASE WHEN any_value(method) <> 'B1' THEN {x} END" if "top1" in c else x
    raw = ", ".join(f"{keep(c, f'count(*) FILTER ({k})')} AS {c}" for c, k in _CONDITIONS.items())
    wsum = lambda c: f"coalesce(sum(weight) FILTER ({_CONDITIONS[c]}), 0)"
    weighted = ", ".join(f"{keep(c, f'round({wsum(c)}, 9)')} AS weighted_{c}" for c in _CONDITIONS)
    ratios = ", ".join(f"{keep(k, f'round({wsum(a)} / nullif({wsum(b)}, 0), 9)')} AS {k}" for k, (a, b) in evaluate.RATIOS.items())
    return f"""SELECT {by}, count(DISTINCT family) AS n_families, {raw}, {weighted}, {ratios}
FROM (SELECT *, 1::DOUBLE / (count(*) OVER (PARTITION BY {by}, family, regime) * count(DISTINCT regime) OVER (PARTITION BY {by}, family)) AS weight FROM {rows}) GROUP BY {by}"""


def block_table(spark, sf_dir) -> DataFrame:
    return summarise_blocks(A.labelled(spark, sf_dir), *KEEP)


def decided(spark, sf_dir, method: str) -> DataFrame:
    return decide(block_table(spark, sf_dir), method, TAU, DELTA)


def _register(method: str):
    m = method.lower()

    @query(f"{m}_select", A.SQL + FAULT + _decided_sql(method) + "SELECT block_id, status, selected FROM d")
    def _(spark, sf_dir):
        return decided(spark, sf_dir, method).select("block_id", "status", "selected")

    counts = ", ".join(f"count(*) FILTER ({k}) AS {c}" for c, k in _CONDITIONS.items() if not (method == "B1" and c == "top1_correct"))

    @query(f"eval_{m}", A.SQL + FAULT + _decided_sql(method) + f"SELECT method, {counts} FROM d GROUP BY method")
    def _(spark, sf_dir):
        wanted = [c for c in evaluate.counts().values()][: -1 if method == "B1" else None]
        return decided(spark, sf_dir, method).groupBy("method").agg(*wanted)


for _m in METHODS:
    _register(_m)


@query("validity", A.SQL + ", v AS (SELECT *, CASE WHEN top_prob > 1 THEN 'probability out of range' WHEN answer = 'other' THEN 'neither yes nor no' END AS f FROM cand) SELECT block_id, arg_min(f, position) FILTER (f IS NOT NULL) AS fault FROM v GROUP BY block_id")
def validity(spark, sf_dir):
    rows = with_fault(A.candidates(spark, sf_dir))
    return rows.groupBy("block_id").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position"))).alias("fault"))


@query("b0_rank", A.SQL + "SELECT block_id, cand_id, 1 + (SELECT count(*) FROM cand o WHERE o.block_id = c.block_id AND ((o.answer = 'yes')::INT > (c.answer = 'yes')::INT OR ((o.answer = 'yes') = (c.answer = 'yes') AND (CASE WHEN c.answer = 'yes' THEN o.top_prob > c.top_prob ELSE o.top_prob < c.top_prob END OR (o.top_prob = c.top_prob AND o.cand_id < c.cand_id))))) AS rank FROM cand c")
def b0_rank(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(*composite_order()))
    return A.candidates(spark, sf_dir).select("block_id", "cand_id", rank.cast("long").alias("rank"))


@query("top2_margin", A.SQL + "SELECT block_id, coalesce(list_reverse_sort(list(p_yes))[1] - list_reverse_sort(list(p_yes))[2], 0) AS margin FROM cand GROUP BY block_id")
def top2_margin(spark, sf_dir):
    return block_table(spark, sf_dir).select("block_id", "margin")


@query("outcomes", A.SQL + FAULT + _decided_sql("S1") + "SELECT block_id, outcome FROM d")
def outcomes(spark, sf_dir):
    return decided(spark, sf_dir, "S1").select("block_id", "outcome")


@query("top1", A.SQL + FAULT + _decided_sql("B0") + _decided_sql("U0", name="e") + "SELECT d.block_id, d.top1 AS top1_b0, e.top1 AS top1_u0 FROM d JOIN e USING (block_id)")
def top1(spark, sf_dir):
    one = decide(block_table(spark, sf_dir), "B0").withColumnRenamed("top1", "top1_b0").drop("method", "status", "selected", "outcome")
    return decide(one, "U0").select("block_id", "top1_b0", F.col("top1").alias("top1_u0"))


@query("exact_mass", A.SQL + """, u AS (SELECT family, sum((mass_yes * 2 ** 58)::HUGEINT) AS s FROM lab GROUP BY family), b AS (SELECT *, (2 ** greatest(length(bin(s)) - 62, 0))::HUGEINT AS p FROM u)
SELECT family, ((s // p)::BIGINT + ((s // p) % 2 = 0 AND s % p <> 0)::INTEGER)::DOUBLE * p::DOUBLE / 2 ** 58 AS mass FROM b""")
def exact_mass(spark, sf_dir):
    """Sum of each family's masses, exact until it is rounded once; as SQL, of whole numbers of 2**-58."""
    return exact_sums(A.labelled(spark, sf_dir), ["family"], {"mass": F.col("mass_yes")})


@query("family_weights", A.SQL + "SELECT block_id, round(1::DOUBLE / (count(*) OVER (PARTITION BY family, regime) * count(DISTINCT regime) OVER (PARTITION BY family)), 12) AS weight FROM qry")
def family_weights(spark, sf_dir):
    return calibrate.block_weights(A.blocks(spark, sf_dir)).select("block_id", F.round("weight", 12).alias("weight"))


@query("eval_weighted", A.SQL + FAULT + _decided_sql("S1") + _report_sql("d", "method"))
def eval_weighted(spark, sf_dir):
    return evaluate.report(evaluate.cells(decided(spark, sf_dir, "S1")), "method")


_UNION = "".join(_decided_sql(m, name=f"d{i}") for i, m in enumerate(METHODS)) + ", a AS (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(len(METHODS))) + ")"


@query("eval_ratios", A.SQL + FAULT + _UNION + f"SELECT method, {', '.join(evaluate.RATIOS)} FROM (" + _report_sql("a", "method") + ")")
def eval_ratios(spark, sf_dir):
    return evaluate.report(evaluate.all_methods(block_table(spark, sf_dir), TAU, DELTA), "method").select("method", *evaluate.RATIOS)


@query("eval_by_tier", A.SQL + FAULT + _UNION + ", t AS (SELECT *, 'all' AS part FROM a UNION ALL SELECT *, tier FROM a) " + _report_sql("t", "method, part"))
def eval_by_tier(spark, sf_dir):
    cell = evaluate.all_methods(block_table(spark, sf_dir), TAU, DELTA)
    return evaluate.report(cell.withColumn("part", F.explode(F.array(F.lit("all"), F.col("tier")))), "method", "part")


_EXPOSED = ", ".join(f"'{x}'" for x in A.EXPOSED)


@query("slice_report", A.SQL + FAULT + _UNION + f""", s AS (SELECT a.*, f.families, l.slice_tier, l.slice_regime FROM a,
 LATERAL (SELECT unnest(['all', CASE WHEN family IN ({_EXPOSED}) THEN 'exposed' ELSE 'unexposed' END, 'family:' || family]) AS families) f,
 LATERAL (SELECT unnest(['all', tier, tier]) AS slice_tier, unnest(['all', 'all', regime]) AS slice_regime) l) """ + _report_sql("s", "method, families, slice_tier, slice_regime"))
def slice_report(spark, sf_dir):
    cell = evaluate.all_methods(block_table(spark, sf_dir), TAU, DELTA)
    return evaluate.report(evaluate.sliced(cell, A.EXPOSED), "method", "families", "slice_tier", "slice_regime")


@query("family_counts", A.SQL + "SELECT family, count(*) AS n FROM qry GROUP BY family")
def family_counts(spark, sf_dir):
    return A.blocks(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n")).orderBy("family")


_CALIB = """, c AS (SELECT *, 1::DOUBLE / (count(*) OVER (PARTITION BY family, regime) * count(DISTINCT regime) OVER (PARTITION BY family)) AS weight FROM b WHERE split = 'calib'),
p AS (SELECT DISTINCT best_p AS p FROM c WHERE NOT bad), k AS (SELECT p, sum(weight) FILTER (present AND NOT bad AND best_p >= p) AS got, sum(weight) FILTER (present) AS need FROM p, c GROUP BY p),
s1 AS (SELECT coalesce(max(p) FILTER (got >= (0.7::DOUBLE - 1e-12) * need), 0) AS tau FROM k)"""


def calibration_blocks(spark, sf_dir) -> DataFrame:
    return block_table(spark, sf_dir).where("split = 'calib'")


def fitted_s1(spark, sf_dir) -> DataFrame:
    """One row: tau."""
    return calibrate.s1_threshold(calibration_blocks(spark, sf_dir))


@query("s1_calibrate", A.SQL + FAULT + _CALIB + "SELECT tau FROM s1")
def s1_calibrate(spark, sf_dir):
    return calibrate.s1_threshold(calibration_blocks(spark, sf_dir))


_GRID = _CALIB + """, t AS (SELECT round(i * 0.1, 2)::DOUBLE AS tau FROM range(11) x(i) UNION SELECT tau FROM s1), dl AS (SELECT unnest([0, 0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS delta),
g AS (SELECT tau, delta, sum(weight) FILTER (ok) AS sel, sum(weight) AS w, sum(weight) FILTER (ok AND present) AS got, sum(weight) FILTER (present) AS pres, sum(weight) FILTER (ok AND u0_label = 'compatible') AS good, sum(weight) FILTER (ok AND u0_label <> 'compatible') AS wrong
 FROM (SELECT *, NOT bad AND best_p >= tau AND margin >= delta AS ok FROM c, t, dl) GROUP BY tau, delta),
m AS (SELECT tau, delta, round(coalesce(sel, 0) / w, 9) AS coverage, round(coalesce(got, 0) / pres, 9) AS present_coverage, round(CASE WHEN sel > 0 THEN coalesce(wrong, 0) / sel END, 9) AS accepted_risk, round(coalesce(good, 0) / pres, 9) AS correct_yield FROM g)"""


@query("s2_grid", A.SQL + FAULT + _GRID + "SELECT * FROM m")
def s2_grid(spark, sf_dir):
    grid = calibrate.s2_grid(calibration_blocks(spark, sf_dir), fitted_s1(spark, sf_dir))
    return grid.withColumns({c: F.round(c, 9) for c in ("coverage", "present_coverage", "accepted_risk", "correct_yield")})


@query("s2_calibrate", A.SQL + FAULT + _GRID + "SELECT coalesce((SELECT tau FROM m WHERE present_coverage >= 0.7 AND accepted_risk IS NOT NULL ORDER BY accepted_risk, correct_yield DESC, tau DESC, delta DESC LIMIT 1), (SELECT tau FROM s1)) AS tau, coalesce((SELECT delta FROM m WHERE present_coverage >= 0.7 AND accepted_risk IS NOT NULL ORDER BY accepted_risk, correct_yield DESC, tau DESC, delta DESC LIMIT 1), 0) AS delta")
def s2_calibrate(spark, sf_dir):
    s1 = fitted_s1(spark, sf_dir)
    return calibrate.s2_choice(calibrate.s2_grid(calibration_blocks(spark, sf_dir), s1), s1)


@query("apply_frozen", A.SQL + FAULT + _CALIB + ", b2 AS (SELECT b.*, tau FROM b, s1 WHERE split = 'test'), d AS (SELECT *, 'S1' AS method, CASE WHEN bad THEN 'failure' WHEN best_p < tau THEN 'defer' WHEN u0_label = 'compatible' THEN 'correct' ELSE 'wrong' END AS outcome, present AND NOT bad AND u0_label = 'compatible' AS top1 FROM b2) " + _report_sql("d", "method"))
def apply_frozen(spark, sf_dir):
    test = block_table(spark, sf_dir).where("split = 'test'")
    test = test.join(F.broadcast(fitted_s1(spark, sf_dir)))  # one row
    return evaluate.report(evaluate.cells(decide(test, "S1", F.col("tau"))), "method")


@query("risk_coverage", A.SQL + FAULT + _CALIB + """, q AS (SELECT p AS tau FROM p UNION SELECT 0 UNION SELECT 1), o AS (SELECT tau, sum(weight) FILTER (ok) AS sel, sum(weight) AS w, sum(weight) FILTER (present) AS pres, sum(weight) FILTER (ok AND u0_label = 'compatible') AS good
 FROM (SELECT *, NOT bad AND best_p >= tau AS ok FROM q, c) GROUP BY tau)
SELECT tau::DOUBLE AS tau, round(coalesce(sel, 0) / w, 9) AS coverage, round((sel - coalesce(good, 0)) / sel, 9) AS accepted_risk, round(coalesce(good, 0) / pres, 9) AS correct_yield FROM o""")
def risk_coverage(spark, sf_dir):
    return calibrate.risk_coverage(calibration_blocks(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("coverage", "accepted_risk", "correct_yield")})


def family_contributions(spark, sf_dir, num: str = "weighted_wrong", den: str = "weighted_selected") -> DataFrame:
    """(ord, num, den) per family, families in order of name."""
    cell = evaluate.cells(decided(spark, sf_dir, "S1"))
    return bootstrap.numbered(evaluate.report(cell, "method", "family", digits=12).select("family", F.col(num).alias("num"), F.col(den).alias("den")), "family")


@query("bootstrap_family")
def bootstrap_family(spark, sf_dir):
    parts = family_contributions(spark, sf_dir)
    return bootstrap.interval(parts, bootstrap.draws_by_choice(spark, parts.count()), bootstrap.REPS)


@query("trigger")
def trigger(spark, sf_dir):
    """Whether no selector's share of right choices among present easy blocks lies surely above chance."""
    blocks = block_table(spark, sf_dir).where("regime = 'present_easy'")
    cell = evaluate.all_methods(blocks, TAU, DELTA)
    sums = evaluate.report(cell, "method", "family", digits=12).select("method", "family", F.col("weighted_correct").alias("num"), F.col("weighted_n_present").alias("den"))
    parts = bootstrap.numbered(sums, "family", "method")
    groups = parts.select("ord").distinct().count()  # all methods decide all blocks, so they have the same families
    low = bootstrap.interval(parts, bootstrap.draws_by_choice(spark, groups), bootstrap.REPS, by=("method",))
    return low.agg(F.coalesce(F.max(F.col("low")) <= calibrate.CHANCE, F.lit(True)).alias("fires"))


@query("answer_mass", A.SQL + "SELECT block_id, position, round(mass_yes / nullif(mass_yes + mass_no, 0), 9) AS p_yes FROM cand")
def answer_mass(spark, sf_dir):
    share = scores.yes_share(F.col("mass_yes"), F.col("mass_no"))
    return A.candidates(spark, sf_dir).select("block_id", F.col("position").cast("long").alias("position"), F.round(share, 9).alias("p_yes"))


_REGIMES = ("present_easy", "present_hard", "absent_easy", "absent_hard")
_RIGHT = "((answer = 'yes') = (label = 'compatible'))"


@query("config_report", A.SQL + f""", a AS (SELECT family, count(*) AS n, count(*) FILTER (answer = 'other') AS failures, round(min(mass_yes + mass_no), 9) AS min_mass, round(avg((answer = 'yes')::INT), 9) AS yes_rate, round(avg({_RIGHT}::INT), 9) AS acc,
 {", ".join(f"round(avg({_RIGHT}::INT) FILTER (regime = '{r}'), 9) AS acc_{r}" for r in _REGIMES)}, round(avg(p_yes) FILTER (label = 'compatible'), 9) AS mean_p_compat, round(avg(p_yes) FILTER (label = 'incompatible'), 9) AS mean_p_incompat, round(avg(price), 6) AS cost, max(price) AS most FROM lab GROUP BY family),
d AS (SELECT family, p_yes, count(*) FILTER (label = 'compatible') AS pos, count(*) FILTER (label = 'incompatible') AS neg FROM lab GROUP BY ALL),
u AS (SELECT x.family, round(sum(CASE WHEN x.p_yes > y.p_yes THEN x.pos * y.neg WHEN x.p_yes = y.p_yes THEN x.pos * y.neg / 2 ELSE 0 END) / sum(x.pos * y.neg), 9) AS auroc FROM d x JOIN d y ON x.family = y.family GROUP BY x.family),
k AS (SELECT c.family, round(avg(CASE WHEN c.p_yes > i.p_yes THEN 1 WHEN c.p_yes = i.p_yes THEN 0.5 ELSE 0 END), 9) AS rank FROM lab c JOIN lab i ON c.block_id = i.block_id AND c.label = 'compatible' AND i.label = 'incompatible' GROUP BY c.family)
SELECT a.*, auroc, rank FROM a LEFT JOIN u USING (family) LEFT JOIN k USING (family)""")
def config_report(spark, sf_dir):
    """One row per configuration: size, failures, accuracy in all and by category, ranking, means by class, cost."""
    rows = A.labelled(spark, sf_dir)
    good = F.col("label") == "compatible"
    right = ((F.col("answer") == "yes") == good).cast("int")
    part = lambda c, x: F.avg(F.when(c, x))
    sums = rows.groupBy("family").agg(
        F.count("*").alias("n"), F.count_if(F.col("answer") == "other").alias("failures"), F.min(F.col("mass_yes") + F.col("mass_no")).alias("min_mass"), F.avg((F.col("answer") == "yes").cast("int")).alias("yes_rate"),
        F.avg(right).alias("acc"), *(part(F.col("regime") == r, right).alias(f"acc_{r}") for r in _REGIMES), part(good, F.col("p_yes")).alias("mean_p_compat"),
        part(~good, F.col("p_yes")).alias("mean_p_incompat"), F.round(F.avg("price"), 6).alias("cost"), F.max("price").alias("most"),
    )
    area = ladder.auroc(rows, "family", "p_yes", good, large=True)
    rank = ladder.auroc_within(rows, "family", "block_id", "p_yes", good).withColumnRenamed("auroc", "rank")
    out = sums.join(area, "family", "left").join(rank, "family", "left")
    rounded = ("min_mass", "yes_rate", "acc", *(f"acc_{r}" for r in _REGIMES), "mean_p_compat", "mean_p_incompat", "auroc", "rank")
    return out.withColumns({c: F.round(c, 9) for c in rounded})
