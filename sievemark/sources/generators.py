"""Generated catalogues: part families, split assignment, presentation order and panels, with seeded choices."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seed and sizes of the split of families.
SPLIT_SEED = 20260922
SPLIT_SIZES = {"dev": 4, "calib": 7, "test": 7}

#: Part families in their order, and the sizes of each family's members in millimetres.
SIZES = {
    "circle": [{"d": 10}, {"d": 13}, {"d": 16}, {"d": 20}, {"d": 24}],
    "square": [{"s": 10}, {"s": 13}, {"s": 16}, {"s": 20}],
    "rect": [{"w": 20, "h": 8}, {"w": 20, "h": 10}, {"w": 16, "h": 8}, {"w": 24, "h": 12}, {"w": 12, "h": 6}],
    "obround": [{"w": 20, "h": 8}, {"w": 16, "h": 8}, {"w": 24, "h": 10}, {"w": 14, "h": 6}],
    "ellipse": [{"w": 20, "h": 12}, {"w": 18, "h": 10}, {"w": 24, "h": 16}],
    "polygon": [{"n": 3, "r": 11}, {"n": 5, "r": 10}, {"n": 6, "r": 10}, {"n": 6, "r": 8}, {"n": 8, "r": 10}],
    "dshape": [{"d": 16, "flat": 2}, {"d": 16, "flat": 4}, {"d": 16, "flat": 6}, {"d": 20, "flat": 4}],
    "double_d": [{"d": 16, "flat": 2}, {"d": 16, "flat": 4}, {"d": 20, "flat": 3}],
    "cross": [{"w": 20, "h": 20, "arm": 5}, {"w": 20, "h": 20, "arm": 8}, {"w": 16, "h": 16, "arm": 6}, {"w": 20, "h": 14, "arm": 6}],
    "tee": [{"w": 20, "h": 16, "t": 6}, {"w": 20, "h": 16, "t": 4}, {"w": 16, "h": 20, "t": 6}],
    "ell": [
        {"w": 18, "h": 18, "t": 6},
        {"w": 18, "h": 18, "t": 6, "mirror": True},
        {"w": 20, "h": 14, "t": 6},
        {"w": 20, "h": 14, "t": 6, "mirror": True},
        {"w": 18, "h": 18, "t": 4},
        {"w": 18, "h": 18, "t": 4, "mirror": True},
    ],
    "star": [
        {"n": 4, "r_out": 11, "r_in": 5.5},
        {"n": 5, "r_out": 11, "r_in": 5.5},
        {"n": 6, "r_out": 11, "r_in": 5.5},
        {"n": 5, "r_out": 11, "r_in": 7},
    ],
    "keyed": [
        {"d": 16, "key_w": 3, "key_h": 2, "keys": "n"},
        {"d": 16, "key_w": 5, "key_h": 2, "keys": "n"},
        {"d": 16, "key_w": 3, "key_h": 2, "keys": "ns"},
        {"d": 16, "key_w": 3, "key_h": 2, "keys": "ne"},
        {"d": 20, "key_w": 4, "key_h": 2, "keys": "n"},
    ],
    "notched": [
        {"w": 16, "h": 12, "nw": 6, "nh": 3, "dx": 0},
        {"w": 16, "h": 12, "nw": 6, "nh": 3, "dx": -4},
        {"w": 16, "h": 12, "nw": 6, "nh": 3, "dx": -4, "mirror": True},
        {"w": 16, "h": 12, "nw": 8, "nh": 4, "dx": 0},
    ],
    "trapezoid": [{"top": 20, "bottom": 14, "h": 8}, {"top": 20, "bottom": 16, "h": 8}, {"top": 16, "bottom": 12, "h": 8}],
    "chamfered": [{"w": 18, "h": 8, "c": 3}, {"w": 18, "h": 8, "c": 3, "mirror": True}, {"w": 18, "h": 8, "c": 5}, {"w": 14, "h": 8, "c": 3}],
    "gear": [{"n": 6, "r_tip": 11, "r_root": 8.5}, {"n": 8, "r_tip": 11, "r_root": 8.5}, {"n": 12, "r_tip": 11, "r_root": 9}],
    "tube": [{"d_out": 14, "d_in": 6}, {"d_out": 14, "d_in": 9}, {"d_out": 18, "d_in": 10}],
}


def part_list() -> list[tuple[str, str, str]]:
    """(part_id, family, params as JSON with sorted keys) of the whole catalogue."""
    return [(f"{family}_{i:02d}", family, json.dumps(params, sort_keys=True)) for family, members in SIZES.items() for i, params in enumerate(members, 1)]


def parts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(part_list(), "part_id string, family string, params string")


def family_splits(families, seed: int = SPLIT_SEED) -> dict[str, str]:
    """Split of each family: sorted, shuffled with the seed, dealt out by SPLIT_SIZES."""
    places = [split for split, size in SPLIT_SIZES.items() for _ in range(size)]
    names = {*families}
    if len(names) != len(places):
        raise ValueError(f"{len(names)} families for {len(places)} places")
    return dict(zip(shuffled(sorted(names), seed), places, strict=True))


def presented(blocks: DataFrame) -> DataFrame:
    """(block_id, position, cand_id) of blocks (block_id, cands): the seeded order in which a block's candidates, a few, are shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, cands in zip(batch.column("block_id").to_pylist(), batch.column("cands").to_pylist(), strict=True):
                order = list(cands)
                random.Random(str(block)).shuffle(order)
                rows += [(block, k, c) for k, c in enumerate(order)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["block_id", "position", "cand_id"])

    return blocks.select("block_id", "cands").mapInArrow(run, "block_id long, position int, cand_id string")


def shuffled(items: list, seed: str | int) -> list:
    """Seeded order: of a block's candidates by the block's id, of families by the split's seed."""
    order = list(items)
    random.Random(seed).shuffle(order)
    return order


#: Seed of the panel, most hard negatives, parts with shrunk bores and by how much these are offset.
PANEL_SEED, HARD, SHRUNK, OFFSETS = 20260924, 12, 4, (-0.3, -1.0)


def panel(ids: list[str], margins: dict[tuple[str, str], tuple[str, float]], family: dict[str, str], symmetric: set[str], least: float, seed: int = PANEL_SEED) -> list[tuple[str, str, str]]:
    """(category, peg, socket) of a pilot panel from parts in order and the (label, margin) of each peg and socket.

    nominal: every part in its own bore. rotated: in its own bore a quarter turned, unless that is the same. clear_neg: in one
    drawn of the bores that it misses by the most that is told apart (least). hard_neg: a draw of pairs of a family that
    do not fit but are nearer. shrunk: a draw of parts, in their bores at each of OFFSETS."""
    rng = random.Random(seed)
    out = [("nominal", p, p) for p in ids] + [("rotated", p, f"{p}_rot90") for p in ids if p not in symmetric]
    for p in ids:
        out.append(("clear_neg", p, rng.choice([q for q in ids if q != p and margins[p, q][1] <= least])))
    near = [(p, q) for p in ids for q in ids if p != q and family[p] == family[q] and margins[p, q][0] == "incompatible" and margins[p, q][1] > least]
    out += [("hard_neg", *pair) for pair in rng.sample(near, min(HARD, len(near)))]
    return out + [("shrunk", p, f"{p}_c{by:+.1f}") for p in rng.sample(ids, SHRUNK) for by in OFFSETS]


def mirror_twins(parts_: DataFrame, *by: str) -> DataFrame:
    """Pairs of a family (and of equal columns by) whose parameters are equal but for `mirror`."""
    kind = "map<string,string>"
    key = F.to_json(F.map_filter(F.from_json("params", kind), lambda k, _: k != "mirror"))
    rows = parts_.select("part_id", "family", key.alias("key"), *by)
    met = rows.withColumnRenamed("part_id", "part_a").join(rows.withColumnRenamed("part_id", "part_b"), ["family", "key", *by])
    return met.where("part_a < part_b").select("part_a", "part_b")
