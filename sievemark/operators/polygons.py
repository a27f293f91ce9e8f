"""Outlines of parts, and raster kernels for what has no closed form (numpy in Arrow batches).

A ring is an array of (x, y) structs, not closed. Rasters share a lattice of multiples of GRID."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overlap import mask_margins

#: Fixed values, in millimetres: lattice, clearance, tolerance, largest interference told apart, gap of a loose fit; steps of a circle.
GRID, CLEARANCE, BAND, CAP, LOOSE, ARC = 0.1, 0.3, 0.05, 2.0, 0.6, 128


def ring(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])


def from_wkt(text: Column) -> Column:
    """Ring of a POLYGON text, closing point included."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?[0-9.]+ -?[0-9.]+)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))


def centroid(r: Column) -> Column:
    """x, y and area by the shoelace formula."""
    nxt = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    cross = F.zip_with(r, nxt, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    total = lambda f: F.aggregate(cross, F.lit(0.0), lambda s, t: s + f(t))
    twice = total(lambda t: t["c"])
    return F.struct((total(lambda t: t["x"] * t["c"]) / (3 * twice)).alias("x"), (total(lambda t: t["y"] * t["c"]) / (3 * twice)).alias("y"), F.abs(twice / 2).alias("area"))


# --- outlines ---


def _arc(r: float, a: float, b: float, x: float = 0.0, y: float = 0.0, n: int = ARC) -> np.ndarray:
    t = np.linspace(a, b, max(2, int(round(n * abs(b - a) / (2 * math.pi))) + 1))
    return np.c_[x + r * np.cos(t), y + r * np.sin(t)]


def _polar(radii, angles) -> np.ndarray:
    return np.c_[radii * np.cos(angles), radii * np.sin(angles)]


def _stairs(*xy: float) -> np.ndarray:
    return np.array(xy, float).reshape(-1, 2)


def _keyed(d, key_w, key_h, keys):
    """Circle with tabs: between tabs an arc, at each tab its two outer corners and where it meets the circle."""
    r, half = d / 2, key_w / 2
    turn = {"e": 0.0, "n": math.pi / 2, "w": math.pi, "s": 3 * math.pi / 2}
    open_ = math.asin(half / r)
    at = sorted(turn[k] for k in keys)
    out = []
    for a, b in zip(at, [*at[1:], at[0] + 2 * math.pi], strict=True):
        c, s = math.cos(a), math.sin(a)
        tab = [(r + key_h, -half), (r + key_h, half)]
        out += [np.array([(x * c - y * s, x * s + y * c) for x, y in tab]), _arc(r, a + open_, b - open_)]
    return np.concatenate(out)


def outline(family: str, p: dict) -> tuple[np.ndarray, float]:
    """Vertices around the outer edge, and the radius of a round hole (0: none)."""
    g = lambda *names: [float(p[n]) for n in names]
    if family in ("circle", "tube"):
        return _arc(p["d" if family == "circle" else "d_out"] / 2, 0, 2 * math.pi)[:-1], p.get("d_in", 0) / 2
    if family in ("square", "rect"):
        w, h = (p["s"], p["s"]) if family == "square" else g("w", "h")
        pts = _stairs(-w / 2, -h / 2, w / 2, -h / 2, w / 2, h / 2, -w / 2, h / 2)
    elif family == "obround":
        w, h = g("w", "h")
        pts = np.r_[_arc(h / 2, -math.pi / 2, math.pi / 2, (w - h) / 2), _arc(h / 2, math.pi / 2, 3 * math.pi / 2, -(w - h) / 2)]
    elif family == "ellipse":
        pts = _arc(1, 0, 2 * math.pi)[:-1] * [p["w"] / 2, p["h"] / 2]
    elif family == "polygon":
        pts = _polar(p["r"], -math.pi / 2 + math.pi / p["n"] * (1 + 2 * np.arange(p["n"])))
    elif family == "dshape":
        a = math.asin(1 - 2 * p["flat"] / p["d"])
        pts = _arc(p["d"] / 2, math.pi - a, 2 * math.pi + a)
    elif family == "double_d":
        a = math.asin(1 - 2 * p["flat"] / p["d"])
        pts = np.r_[_arc(p["d"] / 2, -a, a), _arc(p["d"] / 2, math.pi - a, math.pi + a)]
    elif family == "cross":
        w, h, a = (x / 2 for x in g("w", "h", "arm"))
        pts = _stairs(w, -a, w, a, a, a, a, h, -a, h, -a, a, -w, a, -w, -a, -a, -a, -a, -h, a, -h, a, -a)
    elif family == "tee":
        w, h, t = p["w"] / 2, p["h"] / 2, float(p["t"])
        pts = _stairs(-t / 2, -h, t / 2, -h, t / 2, h - t, w, h - t, w, h, -w, h, -w, h - t, -t / 2, h - t)
    elif family == "ell":
        w, h, t = p["w"] / 2, p["h"] / 2, float(p["t"])
        pts = _stairs(-w, -h, w, -h, w, t - h, t - w, t - h, t - w, h, -w, h)
    elif family == "star":
        k = np.arange(2 * p["n"])
        pts = _polar(np.where(k % 2 == 0, p["r_out"], p["r_in"]), math.pi / 2 + math.pi * k / p["n"])
    elif family == "keyed":
        pts = _keyed(*g("d", "key_w", "key_h"), p["keys"])
    elif family == "notched":
        w, h, n, d, x = (*(v / 2 for v in g("w", "h", "nw")), float(p["nh"]), float(p["dx"]))
        pts = _stairs(-w, -h, w, -h, w, h, x + n, h, x + n, h - d, x - n, h - d, x - n, h, -w, h)
    elif family == "trapezoid":
        t, b, h = (v / 2 for v in g("top", "bottom", "h"))
        pts = _stairs(-b, -h, b, -h, t, h, -t, h)
    elif family == "chamfered":
        w, h, c = p["w"] / 2, p["h"] / 2, float(p["c"])
        pts = _stairs(-w, -h, w, -h, w, h - c, w - c, h, -w, h)
    elif family == "gear":
        step = 2 * math.pi / p["n"]
        tooth = math.pi / 2 + step * (np.arange(p["n"])[:, None] + np.array([-0.3, -0.15, 0.15, 0.3]))
        pts = _polar(np.tile([p["r_root"], p["r_tip"], p["r_tip"], p["r_root"]], p["n"]), tooth.ravel())
    else:
        raise ValueError(f"unknown family {family!r}")
    if p.get("mirror"):
        pts = pts * [-1, 1]
    return pts - area_centre(pts)[0], 0.0


def area_centre(pts: np.ndarray) -> tuple[np.ndarray, float]:
    nxt = np.roll(pts, -1, axis=0)
    c = pts[:, 0] * nxt[:, 1] - nxt[:, 0] * pts[:, 1]
    return ((pts + nxt) * c[:, None]).sum(axis=0) / (3 * c.sum()), abs(c.sum()) / 2


def profiles(parts: DataFrame) -> DataFrame:
    """part_id, family, ring and hole of catalogue rows (part_id, family, params, and scale if there)."""
    scaled = "scale" in parts.columns

    def run(batches):
        for b in batches:
            made = [outline(f, json.loads(p)) for f, p in zip(b.family, b.params, strict=True)]
            if scaled:
                made = [(pts * k, hole * k) for (pts, hole), k in zip(made, b.scale, strict=True)]
            yield pd.DataFrame({"part_id": b.part_id, "family": b.family, "ring": [[{"x": float(x), "y": float(y)} for x, y in pts] for pts, _ in made], "hole": [h for _, h in made]})

    return parts.mapInPandas(run, "part_id string, family string, ring array<struct<x:double,y:double>>, hole double")


# --- rasters ---

#: Points up to which all edges are taken at once.
FEW = 4096


def lattice(pts: np.ndarray, pad: float = 0.0):
    lo, hi = np.floor((pts.min(axis=0) - pad) / GRID), np.ceil((pts.max(axis=0) + pad) / GRID)
    return np.meshgrid(np.arange(lo[0], hi[0] + 1) * GRID, np.arange(lo[1], hi[1] + 1) * GRID)


def inside(pts: np.ndarray, hole: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a ring with a round hole."""
    odd = np.zeros(x.shape, bool)
    if x.size <= FEW:
        (ax, ay), (bx, by) = pts.T[:, :, None], np.roll(pts, -1, axis=0).T[:, :, None]
        x_, y_ = x.ravel()[None], y.ravel()[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            hits = ((ay > y_) != (by > y_)) & (x_ < (bx - ax) * (y_ - ay) / (by - ay) + ax)
        odd = (np.count_nonzero(hits, axis=0) % 2 == 1).reshape(x.shape)
        return odd & (x * x + y * y >= hole * hole) if hole else odd
    for (ax, ay), (bx, by) in zip(pts, np.roll(pts, -1, axis=0), strict=True):
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd & (x * x + y * y >= hole * hole) if hole else odd


def edge_distance(pts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.full(x.shape, np.inf)
    if x.size <= FEW:
        ax, ay = pts.T[:, :, None]
        dx, dy = (np.roll(pts, -1, axis=0) - pts).T[:, :, None]
        px, py = x.ravel()[None] - ax, y.ravel()[None] - ay
        t = np.clip((px * dx + py * dy) / np.maximum(dx * dx + dy * dy, 1e-18), 0, 1)
        return np.sqrt(((px - t * dx) ** 2 + (py - t * dy) ** 2).min(axis=0)).reshape(x.shape)
    for (ax, ay), (bx, by) in zip(pts, np.roll(pts, -1, axis=0), strict=True):
        dx, dy = bx - ax, by - ay
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-18), 0, 1)
        np.minimum(out, np.hypot(x - ax - t * dx, y - ay - t * dy), out=out)
    return out


def grown(pts: np.ndarray, hole: float, by: float, pad: float) -> np.ndarray:
    """Raster of a shape grown by a distance; its hole shrinks likewise."""
    x, y = lattice(pts, pad)
    return (inside(pts, 0.0, x, y) | (edge_distance(pts, x, y) <= by)) & (np.hypot(x, y) >= max(0.0, hole - by) if hole else True)


def fits_shifted(peg: np.ndarray, outside: np.ndarray) -> bool:
    """Whether the mask fits somewhere in the free part, by correlation in the frequency domain."""
    if peg.shape[0] > outside.shape[0] or peg.shape[1] > outside.shape[1]:
        return False
    size = [a + b - 1 for a, b in zip(peg.shape, outside.shape, strict=True)]
    hits = np.fft.irfft2(np.fft.rfft2(outside, size) * np.fft.rfft2(peg[::-1, ::-1], size), size)
    valid = hits[peg.shape[0] - 1 : outside.shape[0], peg.shape[1] - 1 : outside.shape[1]]
    return bool((valid < 0.5).any())


def _points(r) -> np.ndarray:
    return np.array([(v["x"], v["y"]) for v in r], float)


def rasters(profiled: DataFrame) -> DataFrame:
    """part_id, points on the lattice inside, and the area that they stand for."""

    def run(batches):
        for b in batches:
            n = [int(inside(_points(r), h, *lattice(_points(r))).sum()) for r, h in zip(b.ring, b.hole, strict=True)]
            yield pd.DataFrame({"part_id": b.part_id, "points": n, "area": [k * GRID * GRID for k in n]})

    return profiled.mapInPandas(run, "part_id string, points long, area double")


def shift_fits(profiled: DataFrame, by: str = "family") -> DataFrame:
    """peg_id, socket_id, fits for all pairs of a family (or of an equal column by), a few outlines: does a quarter turn of the peg fit the socket after a shift?

    The socket is the part grown by its clearance, the tolerance and a grid step, so that no fit is missed. Its raster is
    made once and used for all pegs of its family."""

    def family(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        shapes = [(i, _points(r), h) for i, r, h in zip(pdf.part_id, pdf.ring, pdf.hole, strict=True)]
        pegs = {i: [inside(t, h, *lattice(t)).astype(float) for t in (p, p[:, ::-1] * [-1, 1], -p, p[:, ::-1] * [1, -1])] for i, p, h in shapes}
        for socket, p, h in shapes:
            reach = CLEARANCE + BAND + GRID
            outside = 1.0 - grown(p, h, reach, reach + 2 * GRID)
            rows += [(peg, socket, any(fits_shifted(m, outside) for m in masks)) for peg, masks in pegs.items()]
        return pd.DataFrame(rows, columns=["peg_id", "socket_id", "fits"])

    n = int(profiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work each
    return profiled.repartition(n, by).groupBy(by).applyInPandas(family, "peg_id string, socket_id string, fits boolean")


# --- fits of all pairs ---


def offset_ring(pts: np.ndarray, by: float) -> np.ndarray:
    """Ring at a distance outside a ring: arcs around its corners, mitres in its notches. Inside it (by < 0): the other way round."""
    if _twice_area(pts) < 0:
        pts = pts[::-1]
    step = np.roll(pts, -1, axis=0) - pts
    pts, step = pts[np.hypot(*step.T) > 1e-12], step[np.hypot(*step.T) > 1e-12]
    unit = step / np.hypot(*step.T)[:, None]
    normal = np.c_[unit[:, 1], -unit[:, 0]]
    out = []
    for p, before, after in zip(pts, np.roll(normal, 1, axis=0), normal, strict=True):
        turn = math.atan2(before[0] * after[1] - before[1] * after[0], before @ after)
        if turn * by < 0 and abs(turn) > 1e-9:
            out.append((p + by * (before + after) / (1 + before @ after))[None])
        else:
            a = math.atan2(before[1], before[0])
            out.append(p + by * _polar(1.0, np.linspace(a, a + turn, 1 + max(1, math.ceil(abs(turn) / (2 * math.pi) * ARC)))))
    return np.concatenate(out)


def _twice_area(pts: np.ndarray) -> float:
    nxt = np.roll(pts, -1, axis=0)
    return float((pts[:, 0] * nxt[:, 1] - nxt[:, 0] * pts[:, 1]).sum())


def bore_of(pts: np.ndarray, hole: float, clearance: float = CLEARANCE) -> tuple[np.ndarray, float]:
    """The nominal bore of a part, its centroid in the origin, and the radius of the pin in a part's hole."""
    grown_ = offset_ring(pts, clearance)
    return grown_ - area_centre(grown_)[0], max(0.0, hole - clearance) if hole else 0.0


def dense(pts: np.ndarray, step: float = GRID) -> np.ndarray:
    """Points along a ring, corners included."""
    nxt = np.roll(pts, -1, axis=0)
    n = np.maximum(1, np.ceil(np.hypot(*(nxt - pts).T) / step).astype(int))
    at = np.repeat(np.arange(len(pts)), n)
    t = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) / n[at]
    return pts[at] + t[:, None] * (nxt - pts)[at]


def signed(pts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance of points to a ring, negative inside."""
    x, y = at.T
    away = edge_distance(pts, x, y)
    return np.where(inside(pts, 0.0, x, y), -away, away)


def fit_of(peg: np.ndarray, hole: float, bore: np.ndarray, pin: float) -> tuple[float, bool]:
    """Signed margin of a peg as it lies (at least -CAP, and -CAP at once if the boxes tell), and whether it is contained."""
    over = max(float((bore.min(axis=0) - peg.min(axis=0)).max()), float((peg.max(axis=0) - bore.max(axis=0)).max()))
    if over >= CAP:
        return -CAP, False
    edge = dense(peg, 2 * GRID)
    out = float(signed(bore, edge).max())
    centre = np.zeros((1, 2))
    room = (hole if hole else max(0.0, float(signed(peg, centre)[0]))) - pin if pin else math.inf  # between the part and the pin
    if out <= 0 and room >= 0:  # also from the bore's corners, where they point at the part
        return min(-out, room, float(edge_distance(peg, *bore.T).min())), True
    return max(-CAP, -max(out, -room)), False


def largest_gap(peg: np.ndarray, bore: np.ndarray) -> float:
    """Distance from the peg of the bore's farthest point."""
    return float(np.maximum(signed(peg, dense(bore)), 0).max())


def inner_radius(pts: np.ndarray, hole: float) -> float:
    """Radius of the largest circle inside, to a tenth of a grid step: by ever finer squares, of which those go whose centres are
    too shallow for a point of the square to be the deepest."""
    step = 16 * GRID
    lo, hi = pts.min(axis=0), pts.max(axis=0)
    x, y = (g.ravel() for g in np.meshgrid(np.arange(lo[0] + step / 2, hi[0] + step / 2, step), np.arange(lo[1] + step / 2, hi[1] + step / 2, step)))
    best = 0.0
    while True:
        depth = -signed(pts, np.c_[x, y])
        if hole:
            depth = np.minimum(depth, np.hypot(x, y) - hole)
        best = max(best, float(depth.max(initial=0.0)))
        if step <= GRID / 10:
            return best
        keep = depth + step * math.sqrt(0.5) > best
        x, y = ((g[keep][:, None] + step / 4 * np.array(away)).ravel() for g, away in ((x, [-1, 1, -1, 1]), (y, [-1, -1, 1, 1])))
        step /= 2


class Socket:
    """A bore with what all pegs need of it."""

    def __init__(self, pts: np.ndarray, hole: float):
        self.ring, self.pin = bore_of(pts, hole)
        self._grown = self._inner = self._outside = None

    def shifted(self, turns: list[np.ndarray], hole: float, area: float, radius: float) -> bool:
        """Whether some turn may fit after a shift, in the bore grown by the tolerance and a grid step. Area, box and inner radius rule
        most pegs out; the inner radius and the raster of what is outside are made when a peg first needs them."""
        if self._grown is None:
            by = BAND + GRID
            ring, pin = offset_ring(self.ring, by), max(0.0, self.pin - by)
            self._grown = ring, pin, np.ptp(ring, axis=0), abs(_twice_area(ring)) / 2 - math.pi * pin**2
        ring, pin, size, most = self._grown
        turns = [t for t in turns if t is not None and (np.ptp(t, axis=0) <= size).all()]
        if area > most or not turns:
            return False
        if self._inner is None:
            self._inner = inner_radius(ring, pin)
        if radius > self._inner + 0.02:
            return False
        if self._outside is None:
            self._outside = 1.0 - inside(ring, pin, *lattice(ring, 2 * GRID))
        return any(fits_shifted(inside(t, hole, *lattice(t)).astype(float), self._outside) for t in turns)

    def label(self, turns: list[np.ndarray], hole: float, area: float, radius: float, alike: list[int] | None = None) -> dict:
        """alike: equal_turns() of turns, if known."""
        alike = alike or equal_turns(turns)
        fits = [fit_of(turns[i], hole, self.ring, self.pin) if i == k else None for k, i in enumerate(alike)]
        fits = [fits[i] for i in alike]
        turns = [t if i == k else None for k, (t, i) in enumerate(zip(turns, alike, strict=True))]
        contained = any(c for _, c in fits)
        margins = [m if c or not contained else -math.inf for m, c in fits]
        k = int(np.argmax(margins))  # of equal ones the smaller turn
        out = {"label": "incompatible", "reason": "", "margin": margins[k], "turn": 90 * k, "max_gap": None, "loose": False}
        if margins[k] >= BAND:
            gap = min(largest_gap(t, self.ring) for t, m in zip(turns, margins, strict=True) if t is not None and m >= BAND)
            return out | {"label": "compatible", "max_gap": gap, "loose": gap > LOOSE}
        if margins[k] >= -BAND:
            return out | {"label": "ambiguous", "reason": "boundary"}
        return out | ({"label": "ambiguous", "reason": "off_centre"} if self.shifted(turns, hole, area, radius) else {})


def quarter_turns(pts: np.ndarray) -> list[np.ndarray]:
    return [pts, pts[:, ::-1] * [-1, 1], -pts, pts[:, ::-1] * [1, -1]]


MATRIX = "peg_id string, socket_id string, label string, reason string, margin double, turn int, max_gap double, loose boolean"


def label_matrix(profiled: DataFrame, block: int = 16) -> DataFrame:
    """Label of every peg in the bore of every part, of its own family or another. All pairs are the result, so they are made: pegs
    lie in blocks by their number, of which each socket meets every one."""
    blocks = max(1, profiled.count() // block)
    pegs = profiled.select(F.pmod(F.xxhash64("part_id"), F.lit(blocks)).alias("b"), F.col("part_id").alias("peg_id"))
    sockets = profiled.select(F.col("part_id").alias("socket_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    return label_pairs(sockets.join(pegs, "b").select("peg_id", "socket_id"), profiled)


def label_pairs(pairs: DataFrame, profiled: DataFrame) -> DataFrame:
    """Labels of distinct pairs (peg_id, socket_id) of outlines. What a socket needs for all of its pegs is worked out once a task."""

    def run(batches):
        socket, shapes = {}, {}
        for b in batches:
            rows = []
            for pid, sid, peg, peg_hole, ring_, hole in zip(b.peg_id, b.socket_id, b.peg_ring, b.peg_hole, b.ring, b.hole, strict=True):
                if sid not in socket:
                    socket = {sid: Socket(_points(ring_), hole)}
                if pid not in shapes:
                    if len(shapes) > 4096:
                        shapes.clear()
                    pts = _points(peg)
                    turns = quarter_turns(pts)
                    shapes[pid] = turns, peg_hole, area_centre(pts)[1] - math.pi * peg_hole**2, inner_radius(pts, peg_hole), equal_turns(turns)
                rows.append({"peg_id": pid, "socket_id": sid} | socket[sid].label(*shapes[pid]))
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in MATRIX.split(", ")])
            yield out.astype({"max_gap": float})

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pegs = profiled.select(F.col("part_id").alias("peg_id"), F.col("ring").alias("peg_ring"), F.col("hole").alias("peg_hole"))
    met = pairs.join(pegs, "peg_id").join(profiled.select(F.col("part_id").alias("socket_id"), "ring", "hole"), "socket_id")
    # outlines of one size (what follows @ in an id) are paired, so tasks that hold few sizes make few pegs; few rows, much work each
    dealt = met.repartitionByRange(n, F.substring_index("socket_id", "@", -1), "socket_id").sortWithinPartitions("socket_id")
    return dealt.select("peg_id", "socket_id", "peg_ring", "peg_hole", "ring", "hole").mapInPandas(run, MATRIX)


def equal_turns(turns: list[np.ndarray]) -> list[int]:
    """For each turn the first that looks the same."""
    same = lambda a, b: np.abs(signed(a, b)).max() <= 1e-6
    return [next(i for i in range(k + 1) if i == k or same(turns[i], turns[k])) for k in range(4)]


def turned_differs(pts: np.ndarray) -> bool:
    """Whether a quarter turn changes an outline."""
    return bool(np.abs(signed(pts, quarter_turns(pts)[1])).max() > 1e-3)


# --- masks of images ---


def stitched(tiles: np.ndarray) -> np.ndarray:
    """One RGB image of bytes from a base image and 2 x 2 tiles, as (5, 3, height, width) with values from -1 to 1."""
    if tiles.shape[0] != 5:
        raise ValueError(f"a base image and four tiles are needed, not {tiles.shape[0]} images")
    rows = np.rint(255 * np.clip((tiles[1:] + 1) / 2, 0, 1)).astype(np.uint8).transpose(0, 2, 3, 1)
    n, h, w, c = rows.shape
    return rows.reshape(2, 2, h, w, c).transpose(0, 2, 1, 3, 4).reshape(2 * h, 2 * w, c)


def render_faults(image: np.ndarray, below: float, area: float, mm_per_pixel: float, border: int = 250, tolerance: float = 0.04) -> list[str]:
    """What is wrong with the picture of a part: its frame must be light, and what is darker than below must have the part's area."""
    faults = []
    frame = np.ones(image.shape[:2], bool)
    frame[1:-1, 1:-1] = False
    if image[frame].min() < border:
        faults.append("the part touches the frame")
    seen = float((image.astype(float).mean(axis=2) < below).sum()) * mm_per_pixel**2
    if abs(seen - area) > tolerance * area:
        faults.append(f"area {seen:.1f} instead of {area:.1f}")
    return faults


def luma_masks(image: np.ndarray, peg_below: float = 197, opening_below: float = 88) -> tuple[np.ndarray, np.ndarray]:
    """Peg and opening in an RGB image, by mean brightness."""
    light = image.astype(float).mean(axis=2)
    return light < peg_below, light < opening_below


def centred_mask(mask: np.ndarray) -> np.ndarray:
    """The mask moved so that its centroid stands in the middle; what leaves the frame is cut."""
    out = np.zeros_like(mask)
    y, x = np.nonzero(mask)
    if len(y):
        y = y + int(round((mask.shape[0] - 1) / 2 - y.mean()))
        x = x + int(round((mask.shape[1] - 1) / 2 - x.mean()))
        ok = (y >= 0) & (y < mask.shape[0]) & (x >= 0) & (x < mask.shape[1])
        out[y[ok], x[ok]] = True
    return out


def signed_margin(peg: np.ndarray, opening: np.ndarray) -> float:
    """Least distance in pixels from the peg to the outside if it is contained, else minus how deep it stands outside."""
    return mask_margins([peg], opening)[0]


def best_turn_margin(peg: np.ndarray, opening: np.ndarray) -> tuple[float, int]:
    """Largest margin over quarter turns, and the smallest turn that has it."""
    found = mask_margins([np.rot90(peg, k) for k in range(4)], opening)
    k = int(np.argmax(found))
    return found[k], 90 * k
