"""Fit of pegs and sockets, similarity, and the construction of candidate sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classes as C
from ..operators import overlap, polygons
from ..operators import rectangles as R
from ..sources import adapters as A
from ..sources import generators
from . import query

#: Margin and gap of a turn: the peg's corner against the bore's, an arc of the clearance's radius.
_MG = "greatest(-2, 0.3::DOUBLE - (sqrt(greatest(0.3::DOUBLE - dx, 0) ** 2 + greatest(0.3::DOUBLE - dy, 0) ** 2) + least(greatest(0.3::DOUBLE - dx, 0.3::DOUBLE - dy), 0)))"
_GAP = "CASE WHEN dx < 0.3::DOUBLE AND dy < 0.3::DOUBLE THEN greatest(dx, dy) ELSE 0.3::DOUBLE + sqrt(greatest(dx - 0.3::DOUBLE, 0) ** 2 + greatest(dy - 0.3::DOUBLE, 0) ** 2) END"
_PAIRS = A.SQL + f""", q AS (SELECT p.split, p.part_id AS peg_id, s.part_id AS socket_id, p.w, p.h, p.bore_w AS own_w, p.bore_h AS own_h, s.bore_w, s.bore_h FROM shapes p JOIN shapes s ON p.split = s.split),
turns AS (SELECT *, t AS turn, (bore_w - CASE t WHEN 0 THEN w ELSE h END) / 2 AS dx, (bore_h - CASE t WHEN 0 THEN h ELSE w END) / 2 AS dy FROM q, (SELECT unnest([0, 90]) AS t)),
m AS (SELECT *, {_MG} AS mg, {_GAP} AS gap FROM turns),
lab2 AS (SELECT split, peg_id, socket_id, any_value(own_w) AS own_w, any_value(own_h) AS own_h, any_value(bore_w) AS bore_w, any_value(bore_h) AS bore_h, max(mg) AS margin, min(turn) FILTER (mg = best) AS turn, min(gap) FILTER (mg >= 0.05::DOUBLE) AS max_gap
 FROM (SELECT *, max(mg) OVER (PARTITION BY peg_id, socket_id) AS best FROM m) GROUP BY ALL),
matrix AS (SELECT *, CASE WHEN margin >= 0.05::DOUBLE THEN 'compatible' WHEN margin >= -0.05::DOUBLE THEN 'ambiguous' ELSE 'incompatible' END AS label FROM lab2),
cls AS (SELECT part_id, min(part_id) OVER (PARTITION BY w, h, bore_w, bore_h) AS shape, split FROM shapes),
byshape AS (SELECT p.shape AS peg_shape, s.shape AS socket_shape, count(*) AS n_pairs, count(*) FILTER (peg_id = socket_id) AS n_same, any_value(margin) AS margin, any_value(label) AS label, any_value(turn) AS turn, any_value(max_gap) AS max_gap,
 any_value(own_w) AS own_w, any_value(own_h) AS own_h, any_value(bore_w) AS bore_w, any_value(bore_h) AS bore_h FROM matrix JOIN cls p ON p.part_id = peg_id JOIN cls s ON s.part_id = socket_id GROUP BY ALL)"""


#: Fixed value: the similarity from which parts count as near duplicates.
NEAR = 0.9


def _iou(a: str, b: str, c: str, d: str) -> str:
    one = lambda x, y: f"least({a}, {x}) * least({b}, {y}) / ({a} * {b} + {c} * {d} - least({a}, {x}) * least({b}, {y}))"
    return f"greatest({one(c, d)}, {one(d, c)})"


_POOL = _PAIRS + f", pool AS (SELECT *, {_iou('own_w', 'own_h', 'bore_w', 'bore_h')} AS sim FROM matrix WHERE peg_id <> socket_id AND label = 'incompatible')"


#: Members of the shapes after the pairs of them.
_MEMBERS = " UNION ALL BY NAME SELECT shape AS {shape}, part_id, split FROM {of}"


def with_members(pairs, members):
    """Pairs of shapes (part_id and split null), and a row for each part with its shape (the other columns null): together they
    stand for every pair of parts, which a join of the members with the pairs on shape gives back."""
    return pairs.unionByName(members, allowMissingColumns=True)


def _with_parts(spark, sf_dir, pairs):
    s = A.shapes(spark, sf_dir)
    return with_members(pairs, C.members(s, C.shape_classes(s), keep=("split",)).withColumnRenamed("class_id", "peg_shape"))


#: The same with how many sockets each part is paired with as a peg.
_LINKED = " UNION ALL BY NAME SELECT shape AS peg_shape, part_id, split, coalesce(n, 0) AS n_links FROM cls LEFT JOIN (SELECT peg_id, count(*) AS n FROM {of} GROUP BY peg_id) ON peg_id = part_id"


def _with_links(spark, sf_dir, pairs, own=True):
    return with_members(pairs, C.peg_links(A.shapes(spark, sf_dir), "split", pairs, own).withColumnRenamed("class_id", "peg_shape"))


def matrix(spark, sf_dir):
    return C.label_matrix(A.shapes(spark, sf_dir), "split")


@query("shape_classes", A.SQL + "SELECT part_id, split, min(part_id) OVER (PARTITION BY w, h, bore_w, bore_h) AS shape, min(part_id) OVER (PARTITION BY split, w, h, bore_w, bore_h) AS class_id FROM shapes")
def shape_classes(spark, sf_dir):
    """Membership of parts in the shapes that pairs are given for, and in the shapes of their catalogue."""
    s = A.shapes(spark, sf_dir)
    whole = C.members(s, C.shape_classes(s)).withColumnRenamed("class_id", "shape")
    return C.members(s, C.shape_classes(s, "split"), "split").join(whole, "part_id").select("part_id", "split", "shape", "class_id")


@query("label_matrix", _PAIRS + "SELECT peg_shape, socket_shape, n_pairs, label, CASE WHEN label = 'ambiguous' THEN 'boundary' ELSE '' END AS reason, round(margin, 9) AS margin, (coalesce(max_gap, 0) > 0.6::DOUBLE)::INTEGER AS loose FROM byshape" + _MEMBERS.format(shape="peg_shape", of="cls"))
def label_matrix(spark, sf_dir):
    """Every peg in every socket of its split, by shapes, and their members."""
    return _with_parts(spark, sf_dir, matrix(spark, sf_dir).select("peg_shape", "socket_shape", "n_pairs", "label", "reason", F.round("margin", 9).alias("margin"), "loose"))


@query("fit_margin", A.SQL + "SELECT part_id, round(CASE WHEN bore_h - 1 < h THEN -least(2, sqrt(greatest(w - bore_w + 1, 0) ** 2 / 4 + (h - bore_h + 1) ** 2 / 4)) ELSE 0 END, 9) AS margin FROM shapes")
def fit_margin(spark, sf_dir):
    """Own peg in its own bore shrunk by 1, so with sharp corners: no turn considered."""
    m = R.margin(F.col("w"), F.col("h"), F.col("bore_w") - 1, F.col("bore_h") - 1)
    return A.shapes(spark, sf_dir).select("part_id", F.round(m, 9).alias("margin"))


@query("best_turn", _PAIRS + "SELECT peg_shape, socket_shape, n_pairs, turn FROM byshape" + _LINKED.format(of="matrix"))
def best_turn(spark, sf_dir):
    return _with_links(spark, sf_dir, matrix(spark, sf_dir).select("peg_shape", "socket_shape", "n_pairs", "turn"))


@query("pair_label", _PAIRS + "SELECT label, count(*) AS n, count(*) FILTER (margin = -2) AS capped FROM matrix GROUP BY label")
def pair_label(spark, sf_dir):
    """How many pairs of parts have each label."""
    return matrix(spark, sf_dir).groupBy("label").agg(F.sum("n_pairs").alias("n"), F.sum(F.when(F.col("margin") == -2, F.col("n_pairs")).otherwise(0)).alias("capped"))


@query("loose_flag", _PAIRS + "SELECT peg_shape, socket_shape, n_pairs, round(max_gap, 9) AS max_gap FROM byshape WHERE label = 'compatible'" + _LINKED.format(of="matrix WHERE label = 'compatible'"))
def loose_flag(spark, sf_dir):
    return _with_links(spark, sf_dir, matrix(spark, sf_dir).where("label = 'compatible'").select("peg_shape", "socket_shape", "n_pairs", F.round("max_gap", 9).alias("max_gap")))


@query("similarity", _PAIRS + f"SELECT peg_shape, socket_shape, n_pairs, round({_iou('own_w', 'own_h', 'bore_w', 'bore_h')}, 9) AS sim FROM byshape" + _LINKED.format(of="matrix"))
def similarity(spark, sf_dir):
    s = R.similarity(*map(F.col, ("own_w", "own_h", "bore_w", "bore_h")))
    return _with_links(spark, sf_dir, C.class_pairs(A.shapes(spark, sf_dir), "split").select("peg_shape", "socket_shape", "n_pairs", F.round(s, 9).alias("sim")))


@query("candidate_pool", _POOL + f"SELECT peg_shape, socket_shape, n_pairs - n_same AS n_pairs, round({_iou('own_w', 'own_h', 'bore_w', 'bore_h')}, 9) AS sim FROM byshape WHERE label = 'incompatible' AND n_pairs > n_same" + _LINKED.format(of="pool"))
def candidate_pool(spark, sf_dir):
    """Sockets of other parts that don't take a peg, by shapes, with how many pairs of parts that is; then every part with its shape and its number of such sockets."""
    out = matrix(spark, sf_dir).where("label = 'incompatible' and n_pairs > n_same")
    return _with_links(spark, sf_dir, out.select("peg_shape", "socket_shape", (F.col("n_pairs") - F.col("n_same")).alias("n_pairs"), F.round("sim", 9).alias("sim")), own=False)


_NEAR = A.SQL + f""", b AS (SELECT part_id, split, bore_w, bore_h, min(part_id) OVER (PARTITION BY bore_w, bore_h) AS shape FROM shapes),
near AS (SELECT a.part_id AS part_a, b.part_id AS part_b, a.shape AS x, b.shape AS y, {_iou('a.bore_w', 'a.bore_h', 'b.bore_w', 'b.bore_h')} AS sim FROM b a JOIN b ON a.part_id < b.part_id AND a.split <> b.split WHERE {_iou('a.bore_w', 'a.bore_h', 'b.bore_w', 'b.bore_h')} >= {NEAR})"""


@query("near_dup", _NEAR + "SELECT least(x, y) AS shape_a, greatest(x, y) AS shape_b, round(any_value(sim), 9) AS similarity, count(*) AS n_pairs FROM near GROUP BY ALL" + _MEMBERS.format(shape="shape_a", of="b"))
def near_dup(spark, sf_dir):
    """Shapes of openings that are alike across splits, the likest first, with how many pairs of parts have them; then the members of all shapes."""
    s = A.shapes(spark, sf_dir)
    near = C.near_classes(s, "split", NEAR).withColumn("similarity", F.round("similarity", 9))
    bores = C.shape_classes(s).groupBy("bore_w", "bore_h").agg(F.min("class_id").alias("class_id"), F.sum("n").alias("n"))
    parts = C.members(s, bores, keep=("split",), sizes=("bore_w", "bore_h")).withColumnRenamed("class_id", "shape_a")
    return with_members(near, parts).orderBy(F.desc_nulls_last("similarity"), "shape_a", "shape_b", "part_id")


@query("near_dup_links", _NEAR + ", e AS (SELECT part_a AS part_id FROM near UNION ALL SELECT part_b FROM near) SELECT b.part_id, any_value(shape) AS shape, count(e.part_id) AS n_links FROM b LEFT JOIN e USING (part_id) GROUP BY b.part_id")
def near_dup_links(spark, sf_dir):
    """Every part with its opening's shape and its number of near duplicates in other splits."""
    return C.near_links(A.shapes(spark, sf_dir), "split", NEAR)


_SIM_E = _iou("e.bore_w", "e.bore_h", "c.bore_w", "c.bore_h")
_EASY = _POOL + f""", r1 AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY peg_id ORDER BY sim, socket_id) = 1),
r2 AS (SELECT c.* FROM pool c JOIN r1 e USING (peg_id) WHERE (c.sim, c.socket_id) > (e.sim, e.socket_id) AND {_SIM_E} <= 0.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY c.peg_id ORDER BY c.sim, c.socket_id) = 1),
r3 AS (SELECT c.* FROM pool c JOIN r1 e USING (peg_id) JOIN r2 f ON f.peg_id = c.peg_id WHERE (c.sim, c.socket_id) > (f.sim, f.socket_id) AND {_SIM_E} <= 0.8::DOUBLE AND {_iou("f.bore_w", "f.bore_h", "c.bore_w", "c.bore_h")} <= 0.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY c.peg_id ORDER BY c.sim, c.socket_id) = 1),
easy AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""


def _to_parts(spark, sf_dir, by_class):
    """Rows of classes for each of their parts, as peg_id."""
    s = A.shapes(spark, sf_dir)
    own = C.members(s, C.shape_classes(s, "split"), "split").select(F.col("part_id").alias("peg_id"), "class_id")
    return own.join(by_class, "class_id").drop("class_id")


def _easy(spark, sf_dir):
    """(class_id, s): the sockets picked for a class, by id."""
    picked = C.pick_easy(C.grid(A.shapes(spark, sf_dir), "split"))
    return picked.select("class_id", F.array_sort(F.transform("easy", lambda e: e["socket_id"])).alias("s"))


@query("pick_easy", _EASY + "SELECT peg_id, 'E' || row_number() OVER (PARTITION BY peg_id ORDER BY socket_id) AS role, socket_id FROM easy")
def pick_easy(spark, sf_dir):
    rows = _to_parts(spark, sf_dir, _easy(spark, sf_dir)).select("peg_id", F.posexplode("s").alias("pos", "socket_id"))
    return rows.select("peg_id", F.concat(F.lit("E"), (F.col("pos") + 1).cast("string")).alias("role"), "socket_id")


_HARD = ", best AS (SELECT peg_id, socket_id, sim, " + _iou("own_w", "own_h", "(own_w - 1.6)", "(own_h - 1.6)") + " AS made FROM pool QUALIFY row_number() OVER (PARTITION BY peg_id ORDER BY sim DESC, socket_id DESC) = 1), hard AS (SELECT peg_id, CASE WHEN made < sim THEN socket_id END AS hard_id, greatest(made, sim) AS hard_sim, CASE WHEN made < sim THEN 'catalog' ELSE 'constructed' END AS hard_kind FROM best)"


@query("pick_hard", _POOL + _HARD + "SELECT peg_id, hard_id, round(hard_sim, 9) AS hard_sim, hard_kind FROM hard")
def pick_hard(spark, sf_dir):
    found = C.pick_hard(C.grid(A.shapes(spark, sf_dir), "split")).where("hard_sim is not null")
    return _to_parts(spark, sf_dir, found).select("peg_id", "hard_id", F.round("hard_sim", 9).alias("hard_sim"), "hard_kind")


@query("eligibility", _EASY + _HARD + """, e AS (SELECT peg_id, count(*) AS n_easy, CASE WHEN count(*) = 3 THEN max(sim) END AS easy_max FROM easy GROUP BY peg_id), np AS (SELECT peg_id, count(*) AS n_pool FROM pool GROUP BY peg_id),
x AS (SELECT o.peg_id, o.label, coalesce(n_pool, 0) AS n_pool, coalesce(n_easy, 0) AS n_easy, easy_max, hard_sim FROM matrix o LEFT JOIN e USING (peg_id) LEFT JOIN np USING (peg_id) LEFT JOIN hard USING (peg_id) WHERE o.peg_id = o.socket_id)
SELECT peg_id, n_pool, n_easy, round(easy_max, 9) AS easy_max, round(hard_sim, 9) AS hard_sim, CASE WHEN label <> 'compatible' THEN 'own socket' WHEN n_easy < 3 THEN 'fewer than 3 distinct' WHEN hard_sim IS NULL THEN 'no hard candidate' WHEN hard_sim < 0.6 THEN 'hard too unlike' WHEN hard_sim - easy_max < 0.15 THEN 'tiers not separate' ELSE '' END AS reason,
 (label = 'compatible' AND n_easy = 3 AND hard_sim >= 0.6 AND hard_sim - easy_max >= 0.15)::INTEGER AS eligible FROM x""")
def eligibility(spark, sf_dir):
    out = C.eligibility(C.grid(A.shapes(spark, sf_dir), "split"))
    return _to_parts(spark, sf_dir, out).withColumns({c: F.round(c, 9) for c in ("easy_max", "hard_sim")})


_CHOSEN = ", ce AS (SELECT peg_id, list(socket_id ORDER BY socket_id) AS s FROM easy GROUP BY peg_id HAVING count(*) = 3)"


@query("regimes_unpivot", _EASY + _HARD + _CHOSEN + """SELECT peg_id, regime, slot, role, CASE role WHEN 'mate' THEN peg_id WHEN 'hard' THEN coalesce(hard_id, -peg_id) WHEN 'e1' THEN s[1] WHEN 'e2' THEN s[2] ELSE s[3] END AS cand FROM ce JOIN hard USING (peg_id),
 (VALUES ('present_easy', 0, 'mate'), ('present_easy', 1, 'e1'), ('present_easy', 2, 'e2'), ('present_hard', 0, 'mate'), ('present_hard', 1, 'hard'), ('present_hard', 2, 'e2'), ('absent_easy', 0, 'e3'), ('absent_easy', 1, 'e1'), ('absent_easy', 2, 'e2'), ('absent_hard', 0, 'e3'), ('absent_hard', 1, 'hard'), ('absent_hard', 2, 'e2')) v(regime, slot, role)""")
def regimes_unpivot(spark, sf_dir):
    found = _easy(spark, sf_dir).where(F.size("s") == 3).join(C.pick_hard(C.grid(A.shapes(spark, sf_dir), "split")), "class_id").where("hard_sim is not null")
    chosen = _to_parts(spark, sf_dir, found).select("peg_id", F.col("peg_id").alias("mate"), F.coalesce("hard_id", -F.col("peg_id")).alias("hard"), *[F.get("s", F.lit(i)).alias(f"e{i + 1}") for i in range(3)])
    return R.regimes(chosen)


@query("compat_per_peg", _PAIRS + ", n AS (SELECT s.split, s.part_id, count(x.socket_id) AS n FROM shapes s LEFT JOIN matrix x ON x.peg_id = s.part_id AND x.socket_id <> x.peg_id AND x.label = 'compatible' GROUP BY ALL) SELECT split, min(n) AS least, list_sort(list(n))[len(list(n)) // 2 + 1] AS median, max(n) AS most FROM n GROUP BY split")
def compat_per_peg(spark, sf_dir):
    return C.spread(C.compatible_counts(C.grid(A.shapes(spark, sf_dir), "split")), "split")


def _margin(w: str, h: str, bw: str, bh: str, r: str) -> str:
    """Best margin over turns in a bore whose corners have the radius r, as SQL."""

    def one(x, y):
        qx, qy = f"({r} - ({bw} - {x}) / 2)", f"({r} - ({bh} - {y}) / 2)"
        return f"greatest(-2, {r} - (sqrt(greatest({qx}, 0) ** 2 + greatest({qy}, 0) ** 2) + least(greatest({qx}, {qy}), 0)))"

    return f"greatest({one(w, h)}, {one(h, w)})"


@query("first_rung", A.SQL + f", s AS (SELECT part_id, s, {_margin('w', 'h', '(bore_w - s)', '(bore_h - s)', 'greatest(0.3::DOUBLE - s / 2, 0)')} AS m FROM shapes, (SELECT unnest([0.3, 0.5, 0.7, 0.9, 1.2])::DOUBLE AS s)) SELECT part_id, min(s) AS shrink FROM s WHERE m < -0.05::DOUBLE GROUP BY part_id")
def first_rung(spark, sf_dir):
    """The first shrink of the bore at which the own peg is surely too large, whichever way it is turned."""
    return R.first_rung(A.shapes(spark, sf_dir), (0.3, 0.5, 0.7, 0.9, 1.2))


@query("aperture_ladder", A.SQL + f""", o AS (SELECT part_id, w, h, unnest([-1.2, -0.6, -0.3, 0.1, 0.3, 0.6, 1.2])::DOUBLE AS o FROM shapes), m AS (SELECT *, {_margin('w', 'h', '(w + 2 * o)', '(h + 2 * o)', 'greatest(o, 0)')} AS m FROM o)
SELECT part_id, o AS offset_mm, CASE WHEN m >= 0.05::DOUBLE THEN 'compatible' WHEN m >= -0.05::DOUBLE THEN 'ambiguous' ELSE 'incompatible' END AS label, round(m, 6) AS margin FROM m""")
def aperture_ladder(spark, sf_dir):
    """Seven bores per peg, from too tight to wide."""
    rows = A.shapes(spark, sf_dir).withColumn("offset_mm", F.explode(F.array(*map(F.lit, (-1.2, -0.6, -0.3, 0.1, 0.3, 0.6, 1.2)))))
    grown = lambda c: F.col(c) + 2 * F.col("offset_mm")
    out = R.labelled(rows, F.col("w"), F.col("h"), grown("w"), grown("h"), F.greatest(F.col("offset_mm"), F.lit(0.0)))
    return out.select("part_id", "offset_mm", "label", F.round("margin", 6).alias("margin"))


_ELL = A.SQL + """, k AS (SELECT w, h, h + 1 AS w2, w AS h2, count(*) AS n FROM shapes GROUP BY ALL),
one AS (SELECT *, unnest([[-w / 2, w / 2, -h / 2, 0], [-w / 2, 0, 0, h / 2]]) AS r FROM k),
two AS (SELECT *, unnest([[-w2 / 2, w2 / 2, -h2 / 2, 0], [-w2 / 2, 0, 0, h2 / 2]]) AS q FROM one),
t AS (SELECT w, h, w2, h2, n, r, turn, CASE turn WHEN 0 THEN q WHEN 1 THEN [-q[4], -q[3], q[1], q[2]] WHEN 2 THEN [-q[2], -q[1], -q[4], -q[3]] ELSE [q[3], q[4], -q[2], -q[1]] END AS q FROM two, (SELECT unnest([0, 1, 2, 3]) AS turn)),
c AS (SELECT w, h, any_value(n) AS n, turn, 0.75::DOUBLE * (w * h + any_value(w2 * h2)) AS whole, sum(greatest(least(r[2], q[2]) - greatest(r[1], q[1]), 0) * greatest(least(r[4], q[4]) - greatest(r[3], q[3]), 0)) AS common FROM t GROUP BY w, h, turn)
"""


@query("outline_similarity", _ELL + "SELECT w, h, any_value(n) AS n, round(max(common / (whole - common)), 9) AS similarity FROM c GROUP BY w, h")
def outline_similarity(spark, sf_dir):
    """Angles made of parts (their box without a quarter of it) against others that lie across and are 1 longer, over quarter turns."""
    rows = A.shapes(spark, sf_dir).groupBy("w", "h").agg(F.count("*").alias("n"))

    def angle(w, h):
        x, y = w / 2, h / 2
        zero = F.lit(0.0)
        return F.array(-x, -y, x, -y, x, zero, zero, zero, zero, y, -x, y)

    pairs = rows.select("w", "h", "n", angle(F.col("w"), F.col("h")).alias("one"), angle(F.col("h") + 1, F.col("w")).alias("two"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = overlap.with_similarity(pairs.repartition(n, "w", "h"), "one", "two")
    return out.select("w", "h", "n", F.round("similarity", 9).alias("similarity"))


@query("has_quarter_symmetry", A.SQL + "SELECT part_id, w = h AS symmetric FROM shapes")
def has_quarter_symmetry(spark, sf_dir):
    """Whether a quarter turn changes less than 0.001 of area."""
    common = F.least("w", "h") * F.least("h", "w")
    return A.shapes(spark, sf_dir).select("part_id", (2 * (F.col("w") * F.col("h") - common) <= 1e-3).alias("symmetric"))


@query("nominal_bore", A.SQL + "SELECT part_id, round((w + 0.6) * (h + 0.6) - (4 - pi()) * 0.09, 9) AS area FROM shapes")
def nominal_bore(spark, sf_dir):
    """Area of the peg's outline grown by the clearance, with rounded corners."""
    c = R.CLEARANCE
    return A.shapes(spark, sf_dir).select("part_id", F.round(F.col("w") * F.col("h") + 2 * c * (F.col("w") + F.col("h")) + F.lit(3.141592653589793 * c * c), 9).alias("area"))


@query("part_checks", A.SQL + "SELECT part_id, CASE WHEN w * h <= 0 THEN 'no area' WHEN greatest(w, h) > 29.4 THEN 'too large' WHEN (40 - greatest(bore_w, bore_h)) / 2 < 5 THEN 'thin wall' ELSE 'ok' END AS fault FROM shapes")
def part_checks(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    fault = F.when(w * h <= 0, "no area").when(F.greatest(w, h) > R.MAX_EXTENT, "too large").when((R.BLOCK - F.greatest("bore_w", "bore_h")) / 2 < R.MIN_WALL, "thin wall").otherwise("ok")
    return A.shapes(spark, sf_dir).select("part_id", fault.alias("fault"))


@query("volumes", A.SQL + "SELECT part_id, w * h * 20 AS peg, round(40 * 40 * 26 - bore_w * bore_h * 22, 6) AS socket FROM shapes")
def volumes(spark, sf_dir):
    """Volume of the extruded peg, and of its block less the cavity."""
    return A.shapes(spark, sf_dir).select("part_id", (F.col("w") * F.col("h") * 20).alias("peg"), F.round(1600 * 26 - F.col("bore_w") * F.col("bore_h") * 22, 6).alias("socket"))


@query("centroid", A.SQL + "SELECT part_id, w / 2 AS x, h / 2 AS y, w * h AS area FROM shapes")
def centroid(spark, sf_dir):
    """Area centroid by the shoelace formula, of rectangles with a corner at the origin."""
    ring = polygons.ring([(F.lit(0.0), F.lit(0.0)), (F.col("w"), F.lit(0.0)), (F.col("w"), F.col("h")), (F.lit(0.0), F.col("h"))])
    c = A.shapes(spark, sf_dir).select("part_id", polygons.centroid(ring).alias("c"))
    return c.select("part_id", "c.x", "c.y", "c.area")


@query("profile_stats", A.SQL + "SELECT part_id, w AS width, h AS height, w * h AS area FROM shapes")
def profile_stats(spark, sf_dir):
    ring = polygons.ring([(-F.col("w") / 2, -F.col("h") / 2), (F.col("w") / 2, -F.col("h") / 2), (F.col("w") / 2, F.col("h") / 2), (-F.col("w") / 2, F.col("h") / 2)])
    s = A.shapes(spark, sf_dir).select("part_id", ring.alias("r"))
    span = lambda c: F.array_max(F.transform("r", lambda v: v[c])) - F.array_min(F.transform("r", lambda v: v[c]))
    return s.select("part_id", span("x").alias("width"), span("y").alias("height"), polygons.centroid(F.col("r"))["area"].alias("area"))


@query("wkt_parse", A.SQL + "SELECT part_id, pos, CASE WHEN pos IN (1, 2) THEN w ELSE 0 END AS x, CASE WHEN pos = 2 THEN h ELSE 0 END AS y FROM shapes, (SELECT unnest([0, 1, 2, 3]) AS pos)")
def wkt_parse(spark, sf_dir):
    text = F.format_string("POLYGON ((0.000000 0.000000, %.6f 0.000000, %.6f %.6f, 0.000000 0.000000))", "w", "w", "h")
    points = A.shapes(spark, sf_dir).select("part_id", F.posexplode(polygons.from_wkt(text)).alias("pos", "p"))
    return points.select("part_id", "pos", "p.x", "p.y")


@query("catalog_gen", A.SQL + A.OUTLINES + " SELECT * FROM outlines")
def catalog_gen(spark, sf_dir):
    """The distinct outlines of parts."""
    return A.outlines(spark, sf_dir).drop("scale")


def outlines(spark, sf_dir):
    """Profiles of the parts' distinct outlines."""
    rows = A.outlines(spark, sf_dir).select("part_id", "family", "params", "scale")
    return polygons.profiles(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part_id"))


@query("profile_vertices")
def profile_vertices(spark, sf_dir):
    return outlines(spark, sf_dir)


@query("mirror_twins", A.SQL + A.OUTLINES + """, k AS (SELECT *, replace(params, '"mirror": true, ', '') AS key FROM outlines) SELECT a.part_id AS part_a, b.part_id AS part_b FROM k a JOIN k b ON a.family = b.family AND a.key = b.key AND a.size = b.size AND a.part_id < b.part_id""")
def mirror_twins(spark, sf_dir):
    """Outlines of parts that mirror each other, at the same size."""
    return generators.mirror_twins(A.outlines(spark, sf_dir), "size")


@query("shift_fit")
def shift_fit(spark, sf_dir):
    """Outlines of parts of one family and size: does one fit another's socket after a shift?"""
    group = F.concat("family", F.lit("@"), F.substring_index("part_id", "@", -1))
    return polygons.shift_fits(outlines(spark, sf_dir).withColumn("group", group), "group")


@query("raster")
def raster(spark, sf_dir):
    return polygons.rasters(outlines(spark, sf_dir))


@query("label_matrix_catalog")
def label_matrix_catalog(spark, sf_dir):
    """Every part in the bore of every part of its catalogue, by outlines, with how many pairs of parts have them."""
    pairs = A.outline_pairs(spark, sf_dir)
    return polygons.label_pairs(pairs.select("peg_id", "socket_id"), outlines(spark, sf_dir)).join(pairs, ["peg_id", "socket_id"])
