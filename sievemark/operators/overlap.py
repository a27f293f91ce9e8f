"""Area that polygons share, for many pairs at once, and exact distances in masks. Both work on arrays; Spark deals the rows.

A simple polygon is a signed sum of the triangles that its edges make with a fixed point, so two polygons share the signed
sum of what their triangles share, whether they are convex or not. Triangles are clipped by the three sides of others, all pairs of
a batch in one step; there are as many as the product of the polygons' edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pairs of triangles that are clipped at once.
AT_ONCE = 200_000


def _fans(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (n, edges, 3, 2), all counter-clockwise, and their signs, of rings (n, edges, 2)."""
    after = np.roll(rings, -1, axis=1)
    cross = rings[..., 0] * after[..., 1] - rings[..., 1] * after[..., 0]
    turned = (cross < 0)[..., None]
    return np.stack([np.zeros_like(rings), np.where(turned, after, rings), np.where(turned, rings, after)], axis=2), np.sign(cross)


def _clipped_area(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Areas that pairs of counter-clockwise triangles (n, 3, 2) share."""
    poly, there = one, np.ones(len(one), bool)
    for k in range(3):
        a, b = two[:, k, None], two[:, (k + 1) % 3, None]
        side = (b[..., 0] - a[..., 0]) * (poly[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (poly[..., 0] - a[..., 0])
        after, side_after = np.roll(poly, -1, axis=1), np.roll(side, -1, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = poly + (after - poly) * np.where(side != side_after, side / (side - side_after), 0)[..., None]
        # a vertex that stays and the point at which its edge leaves or comes back; the others become the one before
        spots = np.stack([poly, cut], axis=2).reshape(len(poly), -1, 2)
        kept = np.stack([side >= 0, (side > 0) & (side_after < 0) | (side < 0) & (side_after > 0)], axis=2).reshape(len(poly), -1)
        last = np.maximum.accumulate(np.where(kept, np.arange(kept.shape[1]), -1), axis=1)
        there &= last[:, -1] >= 0
        last = np.where(last < 0, last[:, -1:], last)
        poly = np.take_along_axis(spots, last[..., None].clip(0), axis=1)
    after = np.roll(poly, -1, axis=1)
    return np.where(there, (poly[..., 0] * after[..., 1] - poly[..., 1] * after[..., 0]).sum(axis=1) / 2, 0.0)


def areas(rings: np.ndarray) -> np.ndarray:
    after = np.roll(rings, -1, axis=1)
    return np.abs((rings[..., 0] * after[..., 1] - rings[..., 1] * after[..., 0]).sum(axis=1)) / 2


def shared_areas(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Area that each ring of (n, edges, 2) shares with the one of the other array; rings may run either way, and repeat points."""
    (s, sign_s), (t, sign_t) = _fans(one), _fans(two)
    out = np.zeros(len(one))
    pairs = s.shape[1] * t.shape[1]
    for at in range(0, len(one), max(1, AT_ONCE // pairs)):
        some = slice(at, at + max(1, AT_ONCE // pairs))
        a, b = np.broadcast_arrays(s[some, :, None], t[some, None, :])
        each = _clipped_area(a.reshape(-1, 3, 2), b.reshape(-1, 3, 2)).reshape(a.shape[:3])
        out[some] = (each * sign_s[some, :, None] * sign_t[some, None, :]).sum(axis=(1, 2))
    return np.abs(out)  # rings that run opposite ways share a negative sum


def similarities(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Largest intersection over union of each pair of rings over quarter turns of the second about the origin; 0 without area."""
    whole, best, turned = areas(one) + areas(two), np.zeros(len(one)), two
    for _ in range(4):
        common = shared_areas(one, turned)
        best = np.maximum(best, np.divide(common, whole - common, out=np.zeros_like(common), where=whole - common > 0))
        turned = np.stack([-turned[..., 1], turned[..., 0]], axis=-1)
    return best


def with_similarity(pairs: DataFrame, one: str, two: str, out: str = "similarity") -> DataFrame:
    """pairs with the similarity of two columns of rings (arrays of x, y, x, y ...); null where a ring is null or empty. Rings of few
    points are padded with their last one, which adds no area."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = [batch.column(c).to_pylist() for c in (one, two)]
            known = [k for k in range(batch.num_rows) if rings[0][k] and rings[1][k]]
            found: list[float | None] = [None] * batch.num_rows
            if known:
                padded = []
                for r in rings:
                    size = max(len(r[k]) for k in known) // 2
                    pts = [np.array(r[k], float).reshape(-1, 2) for k in known]
                    padded.append(np.array([np.concatenate([p, np.repeat(p[-1:], size - len(p), axis=0)]) for p in pts]))
                for k, x in zip(known, similarities(*padded).tolist(), strict=True):
                    found[k] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{kinds}, `{out}` double")


# --- masks ---


def distances_to(targets: np.ndarray) -> np.ndarray:
    """Euclidean distance of every pixel to the nearest target, exact; infinite without one.

    First along columns; then, for all rows at once, by the lower envelope of the parabolas that the columns' distances
    raise: each pixel's parabola enters the envelope once and leaves it at most once."""
    if not targets.any():
        return np.full(targets.shape, np.inf)
    h, w = targets.shape
    far = 4 * (h + w)  # further than any pixel
    at = np.arange(h)[:, None]
    above = at - np.maximum.accumulate(np.where(targets, at, -far), axis=0)
    below = np.minimum.accumulate(np.where(targets, at, far + h)[::-1], axis=0)[::-1] - at
    f = np.minimum(np.minimum(above, below), far).astype(float) ** 2
    rows = np.arange(h)
    place, start, top = np.zeros((h, w), int), np.full((h, w + 1), np.inf), np.zeros(h, int)
    start[:, 0] = -np.inf
    for q in range(1, w):
        left, meets = rows, np.empty(h)
        while len(left):
            v = place[left, top[left]]
            s = (f[left, q] + q * q - f[left, v] - v * v) / (2 * (q - v))
            hidden = s <= start[left, top[left]]
            meets[left] = s
            top[left[hidden]] -= 1
            left = left[hidden]
        top += 1
        place[rows, top], start[rows, top], start[rows, top + 1] = q, meets, np.inf
    out, k = np.empty((h, w)), np.zeros(h, int)
    for q in range(w):
        while (later := start[rows, k + 1] < q).any():
            k += later
        v = place[rows, k]
        out[:, q] = f[rows, v] + (q - v) ** 2
    return np.sqrt(out)


def mask_margins(pegs: list[np.ndarray], opening: np.ndarray) -> list[float]:
    """For each mask of a peg the least distance in pixels from it to the outside if it is contained, else minus how deep it stands
    outside. Distances are taken once, whatever the number of pegs."""
    to_outside, to_opening = distances_to(~opening), distances_to(opening)
    return [-float(to_opening[out].max()) if (out := p & ~opening).any() else float(to_outside[p].min()) for p in pegs]
