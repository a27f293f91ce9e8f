"""Shared areas of polygons and distances in masks against lattices and all pairs; draws against the generators."""

import collections
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import bootstrap, keyed, overlap, polygons
from sievemark.sources import generators


def lattice_area(a, b, step=0.05):
    x, y = np.meshgrid(np.arange(-20, 20, step) + step / 2, np.arange(-20, 20, step) + step / 2)
    return float((polygons.inside(a, 0.0, x, y) & polygons.inside(b, 0.0, x, y)).sum()) * step**2


def test_shared_areas_of_boxes():
    rng = np.random.default_rng(3)
    low, size = rng.uniform(-4, 2, (2, 200, 2)), rng.uniform(0, 5, (2, 200, 2))
    corner = lambda k, x, y: low[k] + size[k] * [x, y]
    box = lambda k, turn: np.stack([corner(k, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))][::turn], axis=1)
    common = np.clip(np.minimum(*(low + size)) - np.maximum(*low), 0, None).prod(axis=1)
    for turn in (1, -1):
        assert overlap.shared_areas(box(0, 1), box(1, turn)) == pytest.approx(common, abs=1e-9)


def test_shared_areas_of_outlines(monkeypatch):
    """All families, not convex ones among them, moved a little; a few at once."""
    parts = {f: polygons.outline(f, json.loads(p))[0] for _, f, p in generators.part_list()}
    assert len(parts) == 18
    names = sorted(parts)
    for k, name in enumerate(names):
        a, b = parts[name], parts[names[(k * 7 + 3) % 18]] + [1.3, -0.7]
        got = overlap.shared_areas(a[None], b[None])[0]
        assert got == pytest.approx(lattice_area(a, b), rel=1e-2, abs=0.3), name
        assert overlap.shared_areas(a[None], a[::-1][None])[0] == pytest.approx(polygons.area_centre(a)[1], rel=1e-9)
    boxes = np.random.default_rng(1).uniform(-3, 3, (50, 5, 2))
    whole = overlap.shared_areas(boxes, boxes[::-1])
    monkeypatch.setattr(overlap, "AT_ONCE", 60)
    assert (overlap.shared_areas(boxes, boxes[::-1]) == whole).all()


def test_similarity_column(spark):
    rows = [
        (1, [0, 0, 4, 0, 4, 2, 0, 2], [0, 0, 0, 4, -2, 4, -2, 0]), (2, [0, 0, 4, 0, 0, 4], None), (3, [], [0, 0, 1, 0, 0, 1]),
        (4, [-1, -1, 1, -1, 1, 1, -1, 1], [-2, -1, 0, -1, 2, -1, 2, 1, -2, 1]), (5, [1, 1, 2, 2], [1, 1, 2, 2]),
    ]
    rows = [(i, *([float(x) for x in r] if r is not None else None for r in rings)) for i, *rings in rows]
    df = spark.createDataFrame(rows, "id int, `a b` array<double>, two array<double>")
    got = {r["id"]: r["sim"] for r in overlap.with_similarity(df, "a b", "two", "sim").collect()}
    assert got == {1: pytest.approx(1.0), 2: None, 3: None, 4: pytest.approx(0.5), 5: 0.0}


def test_distances():
    rng = np.random.default_rng(5)
    for h, w, share in ((1, 1, 1.0), (1, 9, 0.2), (9, 1, 0.2), (13, 17, 0.02), (13, 17, 0.3), (30, 21, 0.01), (24, 24, 0.97)):
        m = rng.random((h, w)) < share
        m.flat[rng.integers(h * w)] = True
        t = np.argwhere(m)
        want = np.array([[np.sqrt(((t - [i, j]) ** 2).sum(axis=1).min()) for j in range(w)] for i in range(h)])
        assert overlap.distances_to(m) == pytest.approx(want, abs=1e-12)
    assert np.isinf(overlap.distances_to(np.zeros((3, 4), bool))).all()


def test_mask_margins():
    frame = lambda half, i, j: (np.abs(np.arange(-half, half + 1))[None, :] <= i) & (np.abs(np.arange(-half, half + 1))[:, None] <= j)
    assert polygons.best_turn_margin(frame(20, 9, 4), frame(20, 8, 13)) == (5.0, 90)
    assert overlap.mask_margins([frame(9, 3, 3), frame(9, 8, 1), frame(9, 8, 9)], frame(9, 4, 5)) == [2.0, -4.0, -np.hypot(4, 4)]


@pytest.mark.parametrize("groups, reps", [(12, 230), (1, 5), (7, 100)])
def test_draws_are_the_generators(spark, groups, reps):
    count = lambda rows: {(rep, i): n for rep, row in enumerate(rows) for i, n in collections.Counter(row).items()}
    got = lambda df: {(r["rep"], r["ord"]): r["times"] for r in df.collect()}
    rng = random.Random(94)
    assert got(bootstrap.draws_by_choice(spark, groups, reps, 94)) == count([[rng.choice(range(groups)) for _ in range(groups)] for _ in range(reps)])
    assert got(bootstrap.draws_by_integers(spark, groups, reps, 94)) == count(np.random.default_rng(94).integers(0, groups, size=(reps, groups)).tolist())


@pytest.mark.parametrize("hot", [1000, 2])
def test_lists_keep_their_order(spark, monkeypatch, hot):
    monkeypatch.setattr(keyed, "HOT", hot)
    known = {f"p{i}": f"d{i}" for i in range(6)}
    lists = {1: ["p3", "p1", "p3", "p0"], 2: ["p1", "no", "p1", None], 3: [], 4: None, 5: ["no"], 6: ["p1"] * 9}
    rows = spark.createDataFrame(list(lists.items()), "id int, paths array<string>")
    manifest = spark.createDataFrame([*known.items(), ("p1", "d1")], "path string, digest string")
    got = {r["id"]: (r["digests"], r["unknown"]) for r in keyed.resolved(rows, ["id"], "paths", manifest).collect()}
    assert got == {i: ([known.get(p) for p in x or []], [k for k, p in enumerate(x or []) if p not in known]) for i, x in lists.items()}


def test_incomplete_joins_tell_how_many(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k int, y int")
    with pytest.raises(Exception, match="2 keys are missing"):
        keyed.joined_complete(left, right, "k").collect()
    whole = keyed.joined_complete(left.where("k in (1, 3)"), right, "k")
    assert sorted((r["k"], r["x"], r["y"]) for r in whole.collect()) == [(1, "a", 10), (3, "c", 30)]
    assert "Nested" not in whole._jdf.queryExecution().executedPlan().toString() and left.withColumn("y", F.lit(1)).count() == 5


def test_blocks_are_shown_in_seeded_order(spark):
    blocks = spark.createDataFrame([(k, [f"{i:03d}" for i in range(k % 5)]) for k in range(40)], "block_id long, cands array<string>")
    got = collections.defaultdict(dict)
    for r in generators.presented(blocks).collect():
        got[r["block_id"]][r["position"]] = r["cand_id"]
    assert {b: [x[i] for i in range(len(x))] for b, x in got.items()} == {k: generators.shuffled([f"{i:03d}" for i in range(k % 5)], str(k)) for k in range(40) if k % 5}


def test_faults_of_maps(spark):
    rows = [({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "x"}), ({"z": "1", "y": None}, {"y": "2"}), ({"a": "5"}, {"a": None}), ({}, {})]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, r struct<one:map<string,string>,two:map<string,string>>")
    got = {r["id"]: r["f"] for r in df.select("id", keyed.map_faults(F.col("r.one"), F.col("r.two")).alias("f")).collect()}
    assert got == {0: ["c is missing", "b differs"], 1: ["z is unknown", "y differs"], 2: [], 3: []}


def test_scaled_outlines(spark):
    parts = spark.createDataFrame([("a", "square", '{"s": 10}', 0.5), ("b", "tube", '{"d_out": 14, "d_in": 6}', 2.0)], "part_id string, family string, params string, scale double")
    got = {r["part_id"]: (max(p["x"] for p in r["ring"]), r["hole"]) for r in polygons.profiles(parts).collect()}
    assert got["a"] == (2.5, 0.0) and got["b"] == (pytest.approx(14), 6.0)
    pairs = spark.createDataFrame([("a", "a"), ("b", "a")], "peg_id string, socket_id string")
    labels = {(r["peg_id"], r["socket_id"]): r["label"] for r in polygons.label_pairs(pairs, polygons.profiles(parts)).collect()}
    assert labels == {("a", "a"): "compatible", ("b", "a"): "incompatible"}
