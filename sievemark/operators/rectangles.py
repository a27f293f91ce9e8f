"""Closed-form geometry of axis-parallel rectangles under quarter turns.

All functions take and return columns; a peg is (w, h), a bore (bore_w, bore_h), both centred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in millimetres and shares.
BAND, CAP, LOOSE, CLEARANCE = 0.05, 2.0, 0.6, 0.3
MAX_EXTENT, MIN_WALL, BLOCK = 29.4, 5.0, 40.0
MAX_PAIR_SIMILARITY, MIN_HARD, MIN_GAP = 0.8, 0.6, 0.15
REGIMES = ("present_easy", "present_hard", "absent_easy", "absent_hard")


def margin(w: Column, h: Column, bw: Column, bh: Column, r: Column | float = 0.0) -> Column:
    """Least clearance a side if contained; else minus how far the bore must grow, at most CAP.

    A bore that is an outline grown by r has arcs of that radius for corners; one that is shrunk has sharp ones (r = 0). The
    margin is the distance of the peg's corner to the bore's edge, negative outside. Null if a size is."""
    r = r if isinstance(r, Column) else F.lit(float(r))
    qx, qy = r - (bw - w) / 2, r - (bh - h) / 2
    beyond = F.hypot(F.greatest(qx, F.lit(0.0)), F.greatest(qy, F.lit(0.0)))
    clear = r - (beyond + F.least(F.greatest(qx, qy), F.lit(0.0)))
    return F.when((qx + qy).isNotNull(), F.greatest(F.lit(-CAP), clear))  # greatest() and least() leave nulls out


def gap(w: Column, h: Column, bw: Column, bh: Column, r: Column | float = 0.0) -> Column:
    """Distance from the peg to the point of the bore that is farthest from it, which is on an arc or where an arc begins."""
    r = r if isinstance(r, Column) else F.lit(float(r))
    ux, uy = (bw - w) / 2 - r, (bh - h) / 2 - r
    far = r + F.hypot(F.greatest(ux, F.lit(0.0)), F.greatest(uy, F.lit(0.0)))
    return F.when((ux < 0) & (uy < 0), F.greatest(ux, uy) + r).otherwise(far)


def measures(w: Column, h: Column, bw: Column, bh: Column, r: Column | float = 0.0) -> Column:
    """Margin and gap as the peg lies and after a quarter turn."""
    return F.struct(margin(w, h, bw, bh, r).alias("flat"), margin(h, w, bw, bh, r).alias("turned"), gap(w, h, bw, bh, r).alias("flat_gap"), gap(h, w, bw, bh, r).alias("turned_gap"))


def label_columns(m: Column) -> dict[str, Column]:
    """From measures: margin at the best turn (ties: the smaller), turn, label (null without sizes), reason, max_gap and loose."""
    flat, turned = m["flat"], m["turned"]
    any_fit = (flat >= 0) | (turned >= 0)
    usable = lambda x: F.when(any_fit & (x < 0), float("-inf")).otherwise(x)
    best = F.greatest(flat, turned)  # a turn that fits exceeds all that don't
    label = F.when(best >= BAND, "compatible").when(best >= -BAND, "ambiguous").when(best.isNotNull(), "incompatible")
    widest = F.least(F.when(flat >= BAND, m["flat_gap"]), F.when(turned >= BAND, m["turned_gap"]))
    return {
        "margin": best, "turn": F.when(usable(flat) >= usable(turned), 0).otherwise(90), "label": label, "reason": F.when(label == "ambiguous", "boundary").otherwise(""),
        "max_gap": widest, "loose": (F.coalesce(widest, F.lit(0.0)) > LOOSE).cast("int"),
    }


def similarity(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Largest intersection over union over quarter turns, centred, sizes as they are."""

    def iou(a, b):
        common = F.least(w1, a) * F.least(h1, b)
        return common / (w1 * h1 + a * b - common)

    return F.greatest(iou(w2, h2), iou(h2, w2))


def labelled(rows: DataFrame, w: Column, h: Column, bw: Column, bh: Column, r: Column | float = 0.0) -> DataFrame:
    """rows with the label columns. Measures are made as rows of a generator, once each: filters on labels are not
    moved below it, where each would work them out again."""
    out = rows.select("*", F.explode_outer(F.array(measures(w, h, bw, bh, r))).alias("__m"))
    return out.withColumns(label_columns(F.col("__m"))).drop("__m")


def first_rung(shapes: DataFrame, shrinks: tuple[float, ...]) -> DataFrame:
    """(part_id, shrink): the first of a list of shrinks at which the own peg no longer fits."""
    rung = F.posexplode(F.array(*map(F.lit, shrinks)))
    rows = shapes.select("part_id", "w", "h", "bore_w", "bore_h", rung.alias("pos", "shrink"))
    corner = F.greatest(F.lit(CLEARANCE) - F.col("shrink") / 2, F.lit(0.0))
    rows = labelled(rows, F.col("w"), F.col("h"), F.col("bore_w") - F.col("shrink"), F.col("bore_h") - F.col("shrink"), corner)
    return rows.where("label = 'incompatible'").groupBy("part_id").agg(F.min_by("shrink", "pos").alias("shrink"))


def regimes(chosen: DataFrame) -> DataFrame:
    """Four blocks of three per part from columns mate, hard, e1, e2, e3: one row per (block, slot)."""
    sets = {"present_easy": ("mate", "e1", "e2"), "present_hard": ("mate", "hard", "e2"), "absent_easy": ("e3", "e1", "e2"), "absent_hard": ("e3", "hard", "e2")}
    rows = [F.struct(F.lit(r).alias("regime"), F.lit(i).alias("slot"), F.lit(c).alias("role"), F.col(c).alias("cand")) for r, cs in sets.items() for i, c in enumerate(cs)]
    return chosen.select("peg_id", F.explode(F.array(*rows)).alias("x")).select("peg_id", "x.*")
