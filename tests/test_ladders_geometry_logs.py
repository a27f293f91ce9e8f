"""Ladders, closed-form and raster geometry, logs and records."""

import collections
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.functions import scores
from sievemark.operators import keyed, ladder, polygons
from sievemark.operators import classes as C
from sievemark.operators import rectangles as R
from sievemark.sources import generators, records
from sievemark.streaming import log_ingest

RUNG = "peg_id int, family int, split string, offset_mm double, margin_mm double, p_yes double, answer string, label string, image_fits int"


def rungs(spark, rows):
    return spark.createDataFrame([(1, r[4] if len(r) > 4 else 1, "calib", float(r[0]), float(r[1]), float(r[2]), "no", r[3], 0) for r in rows], RUNG)


def test_bins_keep_censored_rows_and_hide_their_margins(spark):
    """Two rungs at the cap, two just above it: all are counted, and only the latter have a margin."""
    p = ladder.prepare(rungs(spark, [(5, ladder.CAP, 0.2, "incompatible"), (6, ladder.CAP, 0.6, "incompatible"), (7, -1.5, 0.3, "incompatible"), (8, -1.25, 0.1, "incompatible")]), 0.55)
    got = {r["margin_bin"]: r for r in ladder.bins(p).collect()}
    capped, rest = got[ladder.CENSORED], got["(-2,-1)"]
    assert (capped["n"], capped["mean_margin"], capped["min_margin"], capped["accepted"]) == (2, None, None, 1)
    assert (rest["n"], rest["mean_margin"], rest["p_median"], rest["accepted"]) == (2, -1.375, 0.2, 0)


def test_transitions(spark):
    """Gate 0.4: closed, open, open, closed, open, which are three changes. The step from a censored margin and that between
    equal margins are unresolved; of the two others the gate falls in one and rises in one."""
    rows = [(0, ladder.CAP, 0.3, "incompatible"), (1, -1.1, 0.45, "incompatible"), (2, -1.1, 0.5, "incompatible"), (3, -0.2, 0.1, "incompatible"), (4, 0.2, 0.95, "compatible")]
    r = ladder.responses(ladder.prepare(rungs(spark, rows), 0.4)).first()
    assert (r["transitions"], r["unresolved"], r["rise"], r["fall"]) == (3, 2, 1, 1)


def test_family_rate(spark):
    """Family 1: of four rows two are compatible, one of them accepted. Family 2: both of two are, both accepted. Balanced, that is
    (1/4 + 2/2) of (2/4 + 2/2)."""
    rows = [(0, 0.1, 0.8, "compatible", 1), (1, 0.1, 0.3, "compatible", 1), (2, -0.3, 0.2, "incompatible", 1), (3, 0.0, 0.8, "ambiguous", 1), (4, 0.2, 0.6, "compatible", 2), (5, 0.2, 0.7, "compatible", 2)]
    r = ladder.family_rate(ladder.prepare(rungs(spark, rows), 0.6), "compatible").first()
    assert (r["raw_rate"], r["balanced_rate"]) == (0.75, pytest.approx((1 / 4 + 2 / 2) / (2 / 4 + 2 / 2)))


@pytest.mark.parametrize("bad", [(0, 0.1, math.nan, "compatible"), (0, -3, 0.5, "incompatible"), (0, 0, 1.5, "compatible"), (0, 0, 0.5, "other")])
def test_out_of_contract_values_stop(spark, bad):
    with pytest.raises(Exception):
        ladder.prepare(rungs(spark, [bad]), 0.5).collect()


def test_rank_statistics(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.4, 1), ("a", 0.4, 0), ("a", 0.9, 1), ("b", 0.5, 1)], "g string, s double, y int")
    got = {r["g"]: r["auroc"] for r in ladder.auroc(rows, "g", "s", F.col("y") == 1).collect()}
    assert got["a"] == pytest.approx(3.5 / 4) and got["b"] is None
    rho = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in ladder.spearman(rho, "g", "x", "y").collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] is None


def label(spark, w, h, bw, bh):
    df = spark.createDataFrame([(float(w), float(h), float(bw), float(bh))], "w double, h double, bore_w double, bore_h double")
    return df.select(*[c.alias(k) for k, c in R.label_columns(R.measures(*map(F.col, df.columns))).items()]).first()


def test_labels(spark):
    r = label(spark, 10, 10, 9.5, 9.5)
    assert r["label"] == "incompatible" and r["margin"] == pytest.approx(-0.25 * math.sqrt(2))
    r = label(spark, 20, 8, 8.6, 20.6)
    assert r["label"] == "compatible" and r["turn"] == 90 and r["margin"] == pytest.approx(0.3)
    assert label(spark, 10, 10, 10.04, 10.04)["label"] == label(spark, 10, 10, 9.96, 9.96)["label"] == "ambiguous"
    assert label(spark, 20, 20, 10, 10)["margin"] == -2.0
    r = label(spark, 10, 10, 13.6, 13.6)
    assert r["loose"] == 1 and r["margin"] == pytest.approx(1.8)


def test_similarity_ignores_turns_not_size(spark):
    df = spark.createDataFrame([(20.0, 10.0, 10.0, 20.0), (20.0, 10.0, 10.0, 5.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(R.similarity(*map(F.col, df.columns))).collect()] == [1.0, 0.25]


def shapes_of(spark, n, seed, groups=3, low=2, high=14):
    """Parts of few sizes, so that some share a shape, with bores that are theirs grown by the clearance."""
    rng = np.random.default_rng(seed)
    sizes = [(float(a), float(b)) for a, b in rng.integers(low, high, (n, 2)) + rng.integers(0, 2, (n, 1)) / 4]
    rows = [(i, f"s{i % groups if i % 5 else 0}", w, h, w + 0.6, h + 0.6) for i, (w, h) in enumerate(sizes)]
    return rows, spark.createDataFrame(rows, "part_id long, split string, w double, h double, bore_w double, bore_h double")


def iou(p, q):
    """Of the openings of two rows."""
    one = lambda a, b: min(p[4], a) * min(p[5], b) / (p[4] * p[5] + a * b - min(p[4], a) * min(p[5], b))
    return max(one(q[4], q[5]), one(q[5], q[4]))


def best_margin(p, q):
    """Of a row's peg in another's bore: distance of the corner to a box with corners of radius 0.3."""

    def turn(w, h):
        x, y = 0.3 - (q[4] - w) / 2, 0.3 - (q[5] - h) / 2
        return max(-2.0, 0.3 - math.hypot(max(x, 0), max(y, 0)) - min(max(x, y), 0))

    return max(turn(p[2], p[3]), turn(p[3], p[2]))


def test_near_classes_and_links_find_all(spark):
    rows, df = shapes_of(spark, 120, 3, low=5, high=9)
    by_id = {r[0]: r for r in rows}
    pairs = [(p, q) for p in rows for q in rows if p[0] < q[0] and p[1] != q[1] and iou(p, q) >= 0.9]
    shape = lambda r: min(x[0] for x in rows if x[4:] == r[4:])
    want = collections.Counter(tuple(sorted((shape(p), shape(q)))) for p, q in pairs)
    got = C.near_classes(df, "split", 0.9).collect()
    assert {(r["shape_a"], r["shape_b"]): r["n_pairs"] for r in got} == want and len(got) < len(pairs)
    assert all(r["similarity"] == pytest.approx(iou(by_id[r["shape_a"]], by_id[r["shape_b"]])) for r in got)
    links = collections.Counter(x[0] for pair in pairs for x in pair)
    assert {r["part_id"]: (r["shape"], r["n_links"]) for r in C.near_links(df, "split", 0.9).collect()} == {r[0]: (shape(r), links[r[0]]) for r in rows}


def test_pairs_by_shape_stand_for_all_pairs(spark):
    rows, df = shapes_of(spark, 80, 4, high=6)
    shape = lambda r: min(x[0] for x in rows if x[2:] == r[2:])
    want = collections.Counter((shape(p), shape(q)) for p in rows for q in rows if p[1] == q[1])
    got = C.label_matrix(df, "split").collect()
    assert {(r["peg_shape"], r["socket_shape"]): r["n_pairs"] for r in got} == want
    assert sum(r["n_same"] for r in got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in got:
        p, q = by_id[r["peg_shape"]], by_id[r["socket_shape"]]
        assert r["margin"] == pytest.approx(best_margin(p, q)) and r["sim"] == pytest.approx(iou(p, q))
    assert {(r["part_id"], r["class_id"]) for r in C.members(df, C.shape_classes(df)).collect()} == {(r[0], shape(r)) for r in rows}


@pytest.mark.parametrize("n, seed, high", [(150, 5, 14), (60, 6, 40), (40, 7, 4), (1, 8, 9)])
def test_searches_by_grid_equal_all_pairs(spark, n, seed, high):
    """Odd rows: a part that its own socket refuses, and one without a size."""
    rows, _ = shapes_of(spark, n, seed, high=high)
    rows.append((1000, "s0", 9.0, 9.0, 5.0, 5.0))
    df = spark.createDataFrame([*rows, (1001, "s1", None, 2.0, 2.6, 2.6)], "part_id long, split string, w double, h double, bore_w double, bore_h double")
    grid = C.grid(df, "split")
    easy = {r["class_id"]: [e["socket_id"] for e in r["easy"]] for r in C.pick_easy(grid).collect()}
    hard = {r["class_id"]: r for r in C.pick_hard(grid).collect()}
    fits = {r["class_id"]: r for r in C.compatible_counts(grid).collect()}
    member = {r["part_id"]: r["class_id"] for r in C.members(df, C.shape_classes(df, "split"), "split").collect()}
    assert set(member) == {r[0] for r in rows}
    for p in rows:
        others = [q for q in rows if q[1] == p[1] and q[0] != p[0]]
        assert fits[member[p[0]]]["found"] == sum(best_margin(p, q) >= 0.05 for q in others)
        if best_margin(p, p) < 0.05:
            assert member[p[0]] not in easy and member[p[0]] not in hard
            continue
        pool = sorted((iou(p, q), q[0], q) for q in others if best_margin(p, q) < -0.05)
        chosen = []
        for _, _, q in pool:
            if len(chosen) < 3 and all(iou(c, q) <= 0.8 for c in chosen):
                chosen.append(q)
        assert easy[member[p[0]]] == [q[0] for q in chosen]
        got = hard[member[p[0]]]
        assert got["n_pool"] == len(pool)
        made = max(iou(p, (0, 0, 0, 0, p[4] - 1.6, p[5] - 1.6)), 0)
        if pool:
            best = max(pool)
            assert got["hard_sim"] == pytest.approx(max(best[0], made)) and got["hard_id"] == (best[1] if best[0] > made else None)
        else:
            assert got["hard_sim"] is None


def test_catalogue_outlines():
    parts = generators.part_list()
    assert len(parts) == 72 and len({f for _, f, _ in parts}) == 18
    for part, family, params in parts:
        pts, hole = polygons.outline(family, json.loads(params))
        centre, area = polygons.area_centre(pts)
        assert abs(centre).max() < 1e-6 and np.ptp(pts, axis=0).max() <= R.MAX_EXTENT, part
        x, y = polygons.lattice(pts)
        assert polygons.inside(pts, hole, x, y).sum() * polygons.GRID**2 == pytest.approx(area - math.pi * hole**2, rel=0.02), part
    square, _ = polygons.outline("keyed", {"d": 16, "key_w": 3, "key_h": 2, "keys": "n"})
    assert polygons.area_centre(square)[1] == pytest.approx(math.pi * 64 + 3 * 2, rel=0.01)


def test_shifted_fit():
    pts = np.array([[-5, -5], [5, -5], [5, 5], [-5, 5]], float)
    peg = polygons.inside(pts, 0, *polygons.lattice(pts)).astype(float)
    outside = 1.0 - polygons.grown(pts, 0, 0.3, 0.6)
    assert polygons.fits_shifted(peg, outside) and not polygons.fits_shifted(np.ones((130, 130)), outside)


def box(w, h, x=0.0, y=0.0):
    return np.array([[-w / 2, -h / 2], [w / 2, -h / 2], [w / 2, h / 2], [-w / 2, h / 2]], float) + [x, y]


def label_of(peg, socket, hole=0.0, peg_hole=0.0):
    return polygons.Socket(socket, hole).label(polygons.quarter_turns(peg), peg_hole, polygons.area_centre(peg)[1], polygons.inner_radius(peg, peg_hole))


def test_offsets():
    """A grown box has straight sides, round corners; a notch gets sharper."""
    grown = polygons.offset_ring(box(10, 6), 0.3)
    assert polygons.area_centre(grown)[1] == pytest.approx(60 + 2 * 0.3 * 16 + math.pi * 0.09, rel=1e-4)
    ell = np.array([[0, 0], [6, 0], [6, 2], [2, 2], [2, 6], [0, 6]], float)
    assert np.hypot(*(polygons.offset_ring(ell, 0.5) - [2.5, 2.5]).T).min() < 1e-9
    assert polygons.inner_radius(box(10, 6), 0.0) == pytest.approx(3, abs=0.02)


@pytest.mark.parametrize("peg, socket", [((10, 6), (10, 6)), ((10, 6), (6, 10)), ((9.5, 6), (10, 6)), ((11, 6), (10, 6)), ((10.7, 7), (10, 6)), ((14.2, 6), (10, 6)), ((3, 3), (10, 6))])
def test_fits_agree_with_closed_forms(peg, socket):
    """Boxes: clearance 0.3 on every side of the socket, with round corners; best of a quarter turn."""

    def margin(w, h):
        x, y = (w - socket[0]) / 2, (h - socket[1]) / 2  # from the centre of the rounded corner
        return max(-2.0, 0.3 - math.hypot(max(x, 0), max(y, 0)) - min(max(x, y), 0))

    got, want = label_of(box(*peg), box(*socket)), max(margin(*peg), margin(*peg[::-1]))
    assert got["margin"] == pytest.approx(want, abs=0.02)
    assert got["label"] == ("compatible" if want >= 0.05 else "ambiguous" if want >= -0.05 else "incompatible")
    if got["label"] == "compatible":
        turned = peg if margin(*peg) >= margin(*peg[::-1]) else peg[::-1]
        gaps = [math.hypot((socket[0] - t[0]) / 2, (socket[1] - t[1]) / 2) + 0.3 for t in (turned, turned[::-1]) if margin(*t) >= 0.05]
        assert got["max_gap"] == pytest.approx(min(gaps), abs=0.02)


def test_fits_of_round_and_odd_shapes():
    ring = lambda d: polygons.outline("circle", {"d": d})[0]
    assert label_of(ring(10), ring(10))["margin"] == pytest.approx(0.3, abs=0.01)
    assert label_of(ring(14), ring(14), hole=3.0)["margin"] == -2.0  # a solid part on a pin
    own = label_of(ring(14), ring(14), hole=3.0, peg_hole=3.0)
    assert own["label"] == "compatible" and own["margin"] == pytest.approx(0.3, abs=0.01)
    tee, _ = polygons.outline("tee", {"w": 20, "h": 16, "t": 6})
    small = box(5, 5)
    beside = label_of(np.array([[0, 0], [9, 0], [9, 5.6], [0, 5.6]], float) - [4.5, 2.8], tee)
    assert label_of(small, tee)["label"] == "compatible" and beside["reason"] in ("off_centre", "")
    slot = np.array([[-8, -3], [8, -3], [8, 3], [2, 3], [2, 9], [-8, 9]], float)
    slot = slot - polygons.area_centre(slot)[0]
    assert label_of(box(9, 11), slot)["reason"] == "off_centre" and label_of(box(12, 11), slot)["label"] == "incompatible"


def test_label_matrix(spark):
    some = [p for p in generators.part_list() if p[1] in ("square", "tube", "circle")]
    profiled = polygons.profiles(spark.createDataFrame(some, "part_id string, family string, params string"))
    got = {(r["peg_id"], r["socket_id"]): r for r in polygons.label_matrix(profiled, block=4).collect()}
    assert len(got) == len(some) ** 2 and all(got[i, i]["label"] == "compatible" and not got[i, i]["loose"] for i, _, _ in some)
    assert got["circle_01", "square_01"]["label"] == "compatible" and got["square_02", "circle_02"]["label"] == "incompatible"
    assert got["circle_02", "tube_01"]["label"] == "incompatible" and got["tube_01", "circle_03"]["loose"]


def test_masks():
    opening, peg, poking = np.zeros((40, 40), bool), np.zeros((40, 40), bool), np.zeros((40, 40), bool)
    opening[10:30, 10:30] = True
    peg[14:26, 14:26] = True
    poking[10:30, 13:33] = True
    assert polygons.signed_margin(peg, opening) == 5.0 and polygons.signed_margin(poking, opening) == -3.0
    assert polygons.best_turn_margin(peg, opening) == (5.0, 0)
    moved = np.roll(peg, 6, axis=1)
    assert (polygons.centred_mask(moved) == polygons.centred_mask(peg)).all()


def test_seeded_choices():
    split = generators.family_splits(generators.SIZES)
    assert sorted(split.values()).count("calib") == 7 and split == generators.family_splits(reversed(list(generators.SIZES)))
    assert generators.shuffled([1, 2, 3], "a") == generators.shuffled([1, 2, 3], "a")
    with pytest.raises(ValueError):
        generators.family_splits(["a"])


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_log_reading(spark):
    row = json.dumps({"key": "k1", "answer": "yes", "p_yes": 0.7, "config": "c"})
    got = records.parsed_log(lines(spark, row, row, "", '{"key": "interrupted"')).collect()
    assert [(r["key"], r["p_yes"]) for r in got] == [("k1", 0.7)]
    for bad in ('{"key":}', '{"answer": "no"}', json.dumps({"key": "k1", "answer": "no", "p_yes": 0.7, "config": "c"})):
        with pytest.raises(Exception):
            records.parsed_log(lines(spark, row, bad)).collect()


def test_only_the_torn_end_of_a_file_is_left_out(spark, tmp_path):
    line = lambda k: json.dumps({"key": k, "answer": "yes", "p_yes": 0.5, "config": "c"})
    torn = '{"key": "stopped", "answ'

    def read(**files):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for name, text in files.items():
            (folder / f"{name}.jsonl").write_text(text)
        return sorted(r["key"] for r in records.read_log(spark, str(folder)).collect())

    assert read(one=f"{line('a')}\n{line('b')}\n{torn}", two=f"{line('c')}\n") == ["a", "b", "c"]
    assert read(one=f"{line('a')}\r\n\n{line('b')}") == ["a", "b"]  # whole, though nothing ends it
    for text in (f"{line('a')}\n{torn}\n{line('c')}\n", f"{line('a')}\n{torn}\n", f"{line('a')}\nno object"):
        with pytest.raises(Exception):
            read(one=text, two=line("d"))


def test_append_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "log")
    make = lambda *kv: spark.createDataFrame([(k, "yes", p, "c") for k, p in kv], "key string, answer string, p_yes double, config string")
    records.append_log(make(("k1", 0.7)), path)
    records.append_log(make(("k1", 0.1), ("k2", 0.4)), path, records.read_log(spark, path))
    assert {r["key"]: r["p_yes"] for r in records.read_log(spark, path).collect()} == {"k1": 0.7, "k2": 0.4}
    records.append_log(make(("k2", 0.9), ("k3", 0.2), ("k3", 0.2)), path)  # looks at the log itself
    assert {r["key"]: r["p_yes"] for r in records.read_log(spark, path).collect()} == {"k1": 0.7, "k2": 0.4, "k3": 0.2}
    with pytest.raises(Exception):
        records.append_log(make(("k4", 0.1), ("k4", 0.2)), path)


def test_streamed_log(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    where = [str(tmp_path / x) for x in ("table", "bad", "check")]
    for n, text in enumerate(['{"key": "a", "p_yes": 0.1}\n{"key": "a", "p_yes": 0.1}\nbroken\n', '{"key": "a", "p_yes": 0.9}\n{"key": "b", "p_yes": 0.2}\n']):
        (folder / f"{n}.json").write_text(text)
        log_ingest.ingest(spark, str(folder), *where).awaitTermination(120)
    assert {r["key"]: r["p_yes"] for r in spark.read.parquet(where[0]).collect()} == {"a": 0.1, "b": 0.2}
    assert [r["value"] for r in spark.read.parquet(where[1]).collect()] == ["broken"]


def test_csv_round_trip(spark, tmp_path):
    df = records.ragged_union(spark.createDataFrame([(1, None)], "a int, b string"), spark.createDataFrame([(2, "x", [1.0, 2.0])], "a int, b string, c array<double>"))
    records.write_csv(df.orderBy("a"), str(tmp_path / "t"))
    got = records.read_csv(spark, str(tmp_path / "t"), "a int, b string, c string").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, None, None), (2, "x", "[1.0,2.0]")]
    with pytest.raises(Exception):
        records.write_csv(df, str(tmp_path / "t"))


def test_records(tmp_path):
    good = {"split": "calib", "n": 3, "counts": {"a": 1, "b": 2}, "thresholds": {"S1": {"tau": 0.5}}}
    assert records.record_faults(good) == []
    for change in ({"split": "test"}, {"n": 4}, {"counts": {"a": True}}, {"thresholds": {"S1": {"tau": math.nan}}}, {"thresholds": {"S2": {"tau": 0.1}}}):
        assert records.record_faults(good | change)
    path = str(tmp_path / "r.json")
    records.write_record(path, good)
    assert records.read_record(path) == good
    with pytest.raises(FileExistsError):
        records.write_record(path, good)
    with pytest.raises(ValueError):
        records.read_record(str(tmp_path / "none"))
    records.guard_split("test", True, good)
    with pytest.raises(PermissionError):
        records.guard_split("test", False, good)


def test_joins_that_must_be_complete(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception):
        keyed.joined_or_fail(a, b, "k").collect()
    assert keyed.joined_or_fail(a.where("k = 1"), b, "k").count() == 1
    assert {(r["path"], r["fault"]) for r in keyed.manifest_faults(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, digest string"), spark.createDataFrame([("a", "9"), ("c", "3")], "path string, digest string")).collect()} == {("a", "changed"), ("b", "unexpected"), ("c", "missing")}


def test_stitched_tiles_and_renders():
    tiles = np.stack([np.full((3, 2, 3), v) for v in (0.0, -1.0, -0.5, 0.5, 2.0)])
    whole = polygons.stitched(tiles)
    assert whole.shape == (4, 6, 3) and [int(whole[y, x, 0]) for y, x in ((0, 0), (0, 5), (3, 0), (3, 5))] == [0, 64, 191, 255]
    with pytest.raises(ValueError):
        polygons.stitched(tiles[:4])
    image = np.full((50, 50, 3), 255, np.uint8)
    image[10:30, 10:35] = 40
    assert polygons.render_faults(image, 88, 500 * 0.01, 0.1) == [] and len(polygons.render_faults(image, 88, 450 * 0.01, 0.1)) == 1
    image[0, 7] = 40
    assert polygons.render_faults(image, 88, 501 * 0.01, 0.1) == ["the part touches the frame"]


def test_answer_tokens(spark):
    known = {"Yes": [5], "yes": [6], "YES": [7, 8], "No": [9], " No": [9], "no": [10, 11]}
    assert scores.single_tokens(lambda x: known.get(x, [1, 2])) == {"yes": [5, 6], "no": [9]}
    with pytest.raises(ValueError):
        scores.single_tokens(lambda x: [3])
    got = spark.createDataFrame([(5,), (9,), (1,)], "top int").select(scores.token_class(F.col("top"), {"yes": [5, 6], "no": [9]}).alias("a")).collect()
    assert [r["a"] for r in got] == ["yes", "no", "other"]


def test_record_checks(tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(name)
    before = records.digests([str(tmp_path / "a"), str(tmp_path / "b")])
    (tmp_path / "b").write_text("c")
    assert records.changed_inputs(before, records.digests([str(tmp_path / "a"), str(tmp_path / "b")])) == [f"{tmp_path / 'b'} changed"]
    assert records.version_of("pyspark") and records.version_of("no-such-package") is None


def test_nested_csv_has_sorted_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, {"z": 1, "b": 2}, (2.5, 1))], "k int, m map<string,int>, s struct<y:double,a:int>").withColumn("half", F.lit(0.125))
    records.write_csv(df, str(tmp_path / "t"), {"half": 2})
    r = records.read_csv(spark, str(tmp_path / "t"), "k int, m string, s string, half double").first()
    assert (json.loads(r["m"]), r["m"][:4], r["s"], r["half"]) == ({"b": 2, "z": 1}, '{"b"', '{"a":1,"y":2.5}', 0.12)
