"""Pairs of parts by classes of equal shape, and searches among them by a grid of sizes.

Parts of one shape are one class, with how many they are; what holds for a pair of classes holds for all pairs of their members, so no
pair of parts is ever a row. Searches per peg (the least and the most similar sockets that don't take it, how many take it) do
not pair classes either: sockets lie in cells of a logarithmic grid over their longer and shorter side, a cell's least and largest
sides bound the margin and the similarity of all in it, and only cells that these bounds can't settle are opened. All columns of
sizes are doubles; parts without a size have no class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rectangles as R
from .keyed import looked_up

SIZES = ["w", "h", "bore_w", "bore_h"]
#: A cell's sides differ by this factor at most; what bounds are widened by, against rounding.
STEP, SLACK = 1.3, 1e-9


def shape_classes(shapes: DataFrame, *by: str) -> DataFrame:
    """(by, sizes, class_id, last, n): the distinct shapes of each group, known by their smallest part_id; the largest one; how many."""
    return shapes.dropna(subset=SIZES).groupBy(*by, *SIZES).agg(F.min("part_id").alias("class_id"), F.max("part_id").alias("last"), F.count("*").alias("n"))


def members(shapes: DataFrame, classes: DataFrame, *by: str, keep: tuple[str, ...] = (), sizes: tuple[str, ...] = tuple(SIZES)) -> DataFrame:
    """(part_id, by, keep, class_id); a class, of equal sizes, may have most of the parts."""
    own = shapes.dropna(subset=SIZES).select("part_id", *by, *keep, *sizes)
    return looked_up(own, classes.select(*by, *sizes, "class_id", "n"), [*by, *sizes], "n", own.count()).select("part_id", *by, *keep, "class_id")


def class_pairs(shapes: DataFrame, by: str) -> DataFrame:
    """(peg_shape, socket_shape, n_pairs, n_same, sizes of both): distinct shapes that meet in some group (by), how many pairs of
    parts that stands for, and how many of these are a part with itself. Rows are bounded by the distinct shapes' square."""
    known = shape_classes(shapes)
    counts = shape_classes(shapes, by).drop("class_id", "last").join(known.select(*SIZES, "class_id"), SIZES).select(by, "class_id", "n")
    met = counts.select(by, F.col("class_id").alias("peg_shape"), F.col("n").alias("n_pegs")).join(counts.select(by, F.col("class_id").alias("socket_shape"), F.col("n").alias("n_sockets")), by)
    met = met.groupBy("peg_shape", "socket_shape").agg(F.sum(F.col("n_pegs") * F.col("n_sockets")).alias("n_pairs"), F.sum(F.when(F.col("peg_shape") == F.col("socket_shape"), F.col("n_pegs")).otherwise(0)).alias("n_same"))
    peg = known.select(F.col("class_id").alias("peg_shape"), "w", "h", F.col("bore_w").alias("own_w"), F.col("bore_h").alias("own_h"))
    return met.join(peg, "peg_shape").join(known.select(F.col("class_id").alias("socket_shape"), "bore_w", "bore_h"), "socket_shape")


def peg_links(shapes: DataFrame, by: str, pairs: DataFrame, own: bool = True) -> DataFrame:
    """(part_id, by, class_id, n_links): every part with its shape and how many sockets of its group (by) are paired with it as a peg, when
    pairs has the (peg_shape, socket_shape) that are. own: its own socket counts, too. Counted by shapes, so no pair of parts is a row."""
    known = shape_classes(shapes)
    counts = shape_classes(shapes, by).drop("class_id", "last").join(known.select(*SIZES, "class_id"), SIZES).select(by, "class_id", "n")
    met = pairs.select("peg_shape", "socket_shape").join(counts.select(by, F.col("class_id").alias("peg_shape")), "peg_shape")
    met = met.join(counts.select(by, F.col("class_id").alias("socket_shape"), "n"), [by, "socket_shape"])
    less = F.lit(0) if own else F.when(F.col("peg_shape") == F.col("socket_shape"), 1).otherwise(0)
    links = met.groupBy(by, F.col("peg_shape").alias("class_id")).agg(F.sum(F.col("n") - less).alias("n_links"))
    parts = members(shapes, known, keep=(by,))
    found = looked_up(parts, counts.join(links, [by, "class_id"]), [by, "class_id"], "n", parts.count())
    return found.select("part_id", by, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def label_matrix(shapes: DataFrame, by: str) -> DataFrame:
    """class_pairs() with label columns and sim, the likeness of the peg's own bore and the socket."""
    out = R.labelled(class_pairs(shapes, by), *map(F.col, SIZES), R.CLEARANCE)
    return out.withColumn("sim", R.similarity(*map(F.col, ("own_w", "own_h", "bore_w", "bore_h"))))


def near_classes(shapes: DataFrame, by: str, least: float) -> DataFrame:
    """(shape_a, shape_b, similarity, n_pairs), shape_a <= shape_b: shapes of similarity least or more, and how many pairs of parts
    of different groups (by) have them. Shapes that like differ by the factor 1/least at most in area and sides, so they
    meet in equal or neighbouring logarithmic classes of their longer and shorter sides."""
    known = shape_classes(shapes).groupBy("bore_w", "bore_h").agg(F.min("class_id").alias("shape"), F.sum("n").alias("n"))
    counts = shape_classes(shapes, by).join(known.select("bore_w", "bore_h", "shape"), ["bore_w", "bore_h"]).groupBy(by, "shape").agg(F.sum("n").alias("n"))
    step = F.log(F.lit(1 / least))
    place = lambda side: F.floor(F.log(side) / step)
    rows = known.withColumns({"a": place(F.greatest("bore_w", "bore_h")), "b": place(F.least("bore_w", "bore_h"))})
    near = F.explode(F.array(*(F.struct(F.lit(da).alias("da"), F.lit(db).alias("db")) for da in (-1, 0, 1) for db in (-1, 0, 1))))
    moved = rows.withColumn("d", near).withColumns({"a": F.col("a") + F.col("d.da"), "b": F.col("b") + F.col("d.db")})
    x = rows.select("a", "b", F.col("shape").alias("shape_a"), F.col("bore_w").alias("w1"), F.col("bore_h").alias("h1"), F.col("n").alias("n1"))
    y = moved.select("a", "b", F.col("shape").alias("shape_b"), F.col("bore_w").alias("w2"), F.col("bore_h").alias("h2"), F.col("n").alias("n2"))
    met = x.join(y, ["a", "b"]).where("shape_a <= shape_b").withColumn("similarity", R.similarity(*map(F.col, ("w1", "h1", "w2", "h2")))).where(F.col("similarity") >= least)
    met = met.select("shape_a", "shape_b", "similarity", "n1", "n2")
    one, two = (counts.select(by, F.col("shape").alias(f"shape_{c}"), F.col("n").alias(f"m{c}")) for c in "ab")
    within = met.select("shape_a", "shape_b").join(one, "shape_a").join(two, [by, "shape_b"]).groupBy("shape_a", "shape_b").agg(F.sum(F.col("ma") * F.col("mb")).alias("within"))
    out = met.join(within, ["shape_a", "shape_b"], "left").withColumn("apart", F.col("n1") * F.col("n2") - F.coalesce("within", F.lit(0)))
    pairs = F.when(F.col("shape_a") == F.col("shape_b"), F.col("apart") / 2).otherwise(F.col("apart")).cast("long")
    return out.select("shape_a", "shape_b", "similarity", pairs.alias("n_pairs")).where("n_pairs > 0")


def near_links(shapes: DataFrame, by: str, least: float) -> DataFrame:
    """(part_id, shape, n_links): the parts with their bore's shape, and how many of other groups (by) are at least so similar."""
    near = near_classes(shapes, by, least).select("shape_a", "shape_b")
    own = shapes.dropna(subset=SIZES)
    known = shape_classes(shapes).groupBy("bore_w", "bore_h").agg(F.min("class_id").alias("shape"), F.sum("n").alias("n"))
    counts = shape_classes(shapes, by).join(known.select("bore_w", "bore_h", "shape"), ["bore_w", "bore_h"]).groupBy(by, "shape").agg(F.sum("n").alias("here"))
    both = near.union(near.select("shape_b", "shape_a").where("shape_a <> shape_b")).toDF("shape", "other")
    sums = both.join(known.select(F.col("shape").alias("other"), "n"), "other").groupBy("shape").agg(F.sum("n").alias("all"))
    inside = both.join(counts.select(by, F.col("shape").alias("other"), "here"), "other").groupBy(by, "shape").agg(F.sum("here").alias("inside"))
    links = counts.join(sums, "shape", "left").join(inside, [by, "shape"], "left").select(by, "shape", "here", (F.coalesce("all", F.lit(0)) - F.coalesce("inside", F.lit(0))).alias("n_links"))
    links = links.join(known.select("shape", "bore_w", "bore_h"), "shape")
    return looked_up(own.select("part_id", by, "bore_w", "bore_h"), links, [by, "bore_w", "bore_h"], "here", own.count()).select("part_id", "shape", "n_links")


# Searches among the sockets of a peg's group


def _place(classes: DataFrame) -> DataFrame:
    """classes with the cell of their bore."""
    longer, shorter = F.greatest("bore_w", "bore_h"), F.least("bore_w", "bore_h")
    step = F.log(F.lit(STEP))
    return classes.withColumns({"longer": longer, "shorter": shorter, "cell": F.struct(F.floor(F.log(longer) / step).alias("a"), F.floor(F.log(shorter) / step).alias("b"))})


def _best_margin(w: Column, h: Column, a: Column, b: Column) -> Column:
    return F.greatest(R.margin(w, h, a, b, R.CLEARANCE), R.margin(h, w, a, b, R.CLEARANCE))


def _iou_bounds(w: Column, h: Column, c: Column) -> tuple[Column, Column]:
    """Least and largest similarity that a rectangle can have with any whose longer side is in [x0, x1] and shorter in [y0, y1]."""

    def one(a, b):
        low = F.least(a, c["x0"]) * F.least(b, c["y0"])
        high = F.least(a, c["x1"]) * F.least(b, c["y1"])
        return low / (a * b + c["x1"] * c["y1"] - low), high / (a * b + c["x0"] * c["y0"] - high)

    flat, turned = one(w, h), one(h, w)
    return F.greatest(flat[0], turned[0]) - SLACK, F.greatest(flat[1], turned[1]) + SLACK


@dataclass(frozen=True)
class Grid:
    """classes: (by, sizes, class_id, last, n, cell, own, the margin in the own socket); cells: (by, cells), the cells of a group with
    the bounds of the sockets in them. An array's length is bounded by the range of sizes."""

    by: str
    classes: DataFrame
    cells: DataFrame


def grid(shapes: DataFrame, by: str) -> Grid:
    classes = _place(shape_classes(shapes, by)).withColumn("own", _best_margin(F.col("w"), F.col("h"), F.col("bore_w"), F.col("bore_h")))
    cell = classes.groupBy(by, "cell").agg(F.min("longer").alias("x0"), F.max("longer").alias("x1"), F.min("shorter").alias("y0"), F.max("shorter").alias("y1"), F.sum("n").alias("n"))
    return Grid(by, classes.drop("longer", "shorter"), cell.groupBy(by).agg(F.collect_list(F.struct("cell", "x0", "x1", "y0", "y1", "n")).alias("cells")))


def _bounded(rows: DataFrame, g: Grid, **more) -> DataFrame:
    """rows of pegs with cells: for each cell of their group the margin (least, most) that the peg has in its sockets, how like their own
    bore these are (low, high), and what else is to be known of a cell. (A few hot groups are split by the adaptive join.)"""
    w, h, bw, bh = (F.col(c) for c in SIZES)

    def about(c):
        low, high = _iou_bounds(bw, bh, c)
        margins = _best_margin(w, h, c["x0"], c["y0"]).alias("least"), _best_margin(w, h, c["x1"], c["y1"]).alias("most")
        return F.struct(c["cell"].alias("cell"), c["n"].alias("n"), *margins, low.alias("low"), high.alias("high"), *(f(c).alias(k) for k, f in more.items()))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # these few rows are much work each
    return rows.repartition(n, "class_id").join(g.cells, g.by).withColumn("cells", F.transform("cells", about))


def _opened(rows: DataFrame, g: Grid, keep) -> DataFrame:
    """A row for each socket class x of the cells that keep() leaves to a peg class (none: one without a socket), with its label columns."""
    sockets = g.classes.select(g.by, "cell", F.struct("class_id", "last", "n", "bore_w", "bore_h").alias("x"))
    some = rows.withColumn("in", F.explode_outer(F.filter("cells", keep))).drop("cells").withColumn("cell", F.col("in.cell"))
    return R.labelled(some.join(sockets, [g.by, "cell"], "left"), F.col("w"), F.col("h"), F.col("x.bore_w"), F.col("x.bore_h"), R.CLEARANCE)


def _refused(c: Column) -> Column:
    return c["most"] < -R.BAND - SLACK


def _open_to(c: Column) -> Column:
    """Some socket of the cell may be incompatible."""
    return c["least"] < -R.BAND + SLACK


def pick_easy(g: Grid) -> DataFrame:
    """(by, class_id, sizes, easy): up to three incompatible sockets (sim, socket_id, sizes) of the group, the least similar first, none
    too like one chosen before. Classes whose own socket doesn't take them get none.

    A cell whose sockets are surely incompatible and surely apart from those chosen says how similar the next one is at most, and
    only cells that may hold one as little similar are opened."""
    rows = g.classes.where(F.col("own") >= R.BAND).select(g.by, "class_id", *SIZES, F.array().cast("array<struct<sim:double,socket_id:long,bore_w:double,bore_h:double>>").alias("easy"))
    to_chosen = lambda c, k: F.array_max(F.transform("easy", lambda e: _iou_bounds(e["bore_w"], e["bore_h"], c)[k]))
    for turn in range(3):
        near = {"apart_low": lambda c: to_chosen(c, 0), "apart_high": lambda c: to_chosen(c, 1)} if turn else {"apart_low": lambda c: F.lit(0.0), "apart_high": lambda c: F.lit(0.0)}
        sure = F.filter("cells", lambda c: _refused(c) & (c["apart_high"] <= R.MAX_PAIR_SIMILARITY))
        enough = F.coalesce(F.array_min(F.transform(sure, lambda c: c["high"])), F.lit(2.0))
        bounded = _bounded(rows, g, **near).withColumn("enough", enough)
        met = _opened(bounded, g, lambda c: _open_to(c) & (c["low"] <= F.col("enough")) & (c["apart_low"] <= R.MAX_PAIR_SIMILARITY))
        sim = R.similarity(F.col("bore_w"), F.col("bore_h"), F.col("x.bore_w"), F.col("x.bore_h"))
        x = F.struct(sim.alias("sim"), F.col("x.class_id").cast("long").alias("socket_id"), F.col("x.bore_w"), F.col("x.bore_h"))
        apart = F.forall("easy", lambda e: R.similarity(e["bore_w"], e["bore_h"], F.col("x.bore_w"), F.col("x.bore_h")) <= R.MAX_PAIR_SIMILARITY)
        found = met.groupBy(g.by, "class_id", *SIZES, "easy").agg(F.min(F.when((F.col("label") == "incompatible") & apart, x)).alias("next"))
        more = F.when(F.col("next").isNotNull(), F.array_append("easy", F.col("next"))).otherwise(F.col("easy"))
        rows = found.select(g.by, "class_id", *SIZES, more.alias("easy"))
    return rows


def pick_hard(g: Grid) -> DataFrame:
    """(class_id, n_pool, hard_id, hard_sim, hard_kind): how many parts have an incompatible socket, the likest of these
    (ties: the last), or a shrunk copy of the own bore if at least as like."""
    rows = g.classes.where(F.col("own") >= R.BAND).select(g.by, "class_id", *SIZES)
    sure = F.filter("cells", _refused)
    known = {"enough": F.coalesce(F.array_max(F.transform(sure, lambda c: c["low"])), F.lit(-1.0)), "counted": F.aggregate(sure, F.lit(0).cast("long"), lambda a, c: a + c["n"])}
    met = _opened(_bounded(rows, g).withColumns(known), g, lambda c: _open_to(c) & (~_refused(c) | (c["high"] >= F.col("enough"))))
    out = F.col("label") == "incompatible"
    sim = R.similarity(F.col("bore_w"), F.col("bore_h"), F.col("x.bore_w"), F.col("x.bore_h"))
    best = met.groupBy("class_id", *SIZES, "counted").agg(
        F.sum(F.when(out & ~_refused(F.col("in")), F.col("x.n")).otherwise(0)).alias("more"), F.max(F.when(out, F.struct(sim.alias("sim"), F.col("x.last").alias("last")))).alias("c"),
    )
    s = R.similarity(F.col("bore_w"), F.col("bore_h"), F.col("bore_w") - 1.6, F.col("bore_h") - 1.6)
    made = s >= F.col("c.sim")
    none = F.col("c").isNull()
    return best.select(
        "class_id", (F.col("counted") + F.col("more")).alias("n_pool"), F.when(~made, F.col("c.last")).alias("hard_id"),
        F.when(~none, F.when(made, s).otherwise(F.col("c.sim"))).alias("hard_sim"), F.when(~none, F.when(made, "constructed").otherwise("catalog")).alias("hard_kind"),
    )


def compatible_counts(g: Grid) -> DataFrame:
    """(by, class_id, n, found): how many sockets of other parts of the group each class fits into."""
    takes = F.filter("cells", lambda c: c["least"] >= R.BAND + SLACK)
    rows = _bounded(g.classes.select(g.by, "class_id", "n", "own", *SIZES), g).withColumn("counted", F.aggregate(takes, F.lit(0).cast("long"), lambda a, c: a + c["n"]))
    met = _opened(rows, g, lambda c: (c["least"] < R.BAND + SLACK) & (c["most"] >= R.BAND - SLACK))
    found = met.groupBy(g.by, "class_id", "n", "own", "counted").agg(F.sum(F.when(F.col("label") == "compatible", F.col("x.n")).otherwise(0)).alias("more"))
    return found.select(g.by, "class_id", "n", (F.col("counted") + F.col("more") - (F.col("own") >= R.BAND).cast("long")).alias("found"))


def spread(counts: DataFrame, by: str) -> DataFrame:
    """Least, upper median and most of found per group, n rows each: by running sums of n over the distinct numbers."""
    level = counts.groupBy(by, "found").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("found"))
    size = F.sum("n").over(Window.partitionBy(by))
    level = level.withColumns({"upto": upto, "size": size})
    middle = F.when((F.col("upto") > F.floor(F.col("size") / 2)), F.col("found"))
    return level.groupBy(by).agg(F.min("found").alias("least"), F.min(middle).alias("median"), F.max("found").alias("most"))


def eligibility(g: Grid) -> DataFrame:
    """One row per class: eligible, and else the first reason why not."""
    out = g.classes.select("class_id", "own").join(pick_easy(g).select("class_id", "easy"), "class_id", "left").join(pick_hard(g), "class_id", "left")
    n_easy = F.coalesce(F.size("easy"), F.lit(0))
    easy_max = F.when(n_easy == 3, F.array_max(F.transform("easy", lambda e: e["sim"])))
    reason = (
        F.when(F.col("own") < R.BAND, "own socket").when(n_easy < 3, "fewer than 3 distinct").when(F.col("hard_sim").isNull(), "no hard candidate")
        .when(F.col("hard_sim") < R.MIN_HARD, "hard too unlike").when(F.col("hard_sim") - easy_max < R.MIN_GAP, "tiers not separate").otherwise("")
    )
    return out.select("class_id", F.coalesce("n_pool", F.lit(0)).cast("long").alias("n_pool"), n_easy.cast("long").alias("n_easy"), easy_max.alias("easy_max"), "hard_sim", reason.alias("reason"), (reason == "").cast("int").alias("eligible"))
