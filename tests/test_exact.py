"""Exact sums, exact quantiles and range joins against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.functions import exact
from sievemark.operators import evaluate, quantiles


def sums(spark, groups, parts=3):
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    random.Random(len(rows)).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
    return {r["g"]: r["s"] for r in exact.exact_sums(df, ["g"], {"s": F.col("x")}).collect()}


def test_exact_sums_of_any_doubles(spark):
    rng = random.Random(1)
    groups = {
        "cancel": [1e16, 0.6, -1e16], "tenths": [0.1] * 10, "tiny": [5e-324, 5e-324, -1e-310], "ends": [1.7e308, -1.7e308, 1.0, 1e-300], "zero": [0.0, -0.0, 2.5, -2.5],
        "above half": [2.0**53, 1.0, 2.0**-60], "half": [2.0**53, 1.0], "half up": [2.0**53 + 2, 1.0], "below": [-1e100, 1.0, 1e100, -3.0, 1e-17],
    }
    for k in range(60):
        reach = 60 if k % 2 else 1000
        xs = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-reach, reach) for _ in range(rng.randrange(1, 40))]
        groups[f"r{k}"] = xs + [-x for x in xs[: len(xs) // 2]] * (k % 3 == 0)
    assert sums(spark, groups) == {g: math.fsum(xs) for g, xs in groups.items()}


def test_exact_sums_of_odd_values(spark):
    got = sums(spark, {"nan": [math.nan, 1.0], "inf": [math.inf, 1.0], "both": [math.inf, -math.inf], "null": [None, None], "some": [None, 0.5], None: [1.5]})
    assert math.isnan(got.pop("nan")) and math.isnan(got.pop("both"))
    assert got == {"inf": math.inf, "null": None, "some": 0.5, None: 1.5} and sums(spark, {"a": []}) == {}


def test_exact_sums_with_multiplicity(spark):
    rows = [("a", 0.1, 3), ("a", -0.3, 1), ("a", 1e17, 0), ("b", 1 / 3, 10**9)]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    got = {r["g"]: (r["s"], r["t"]) for r in exact.exact_sums(df, ["g"], {"s": (F.col("x"), F.col("n")), "t": F.col("x")}).collect()}
    third = int(1 / 3 * 2**60)
    assert got == {"a": (math.fsum([0.1] * 3 + [-0.3]), math.fsum([0.1, -0.3, 1e17])), "b": (third * 10**9 / 2**60, 1 / 3)}


def test_weighted_counts_are_exact(spark):
    """Weights of many magnitudes: what plain sums lose depends on the order of rows."""
    cells = [("m", f"f{k}", "easy", "r", 1) for k in range(4)]
    names = "method string, family string, tier string, regime string"
    df = spark.createDataFrame([(*c[:4], *[1] * len(evaluate.COUNTS)) for c in cells], f"{names}, {', '.join(f'{c} long' for c in evaluate.COUNTS)}")
    df = df.withColumn("regime", F.concat("regime", F.substring("family", 2, 1)))
    w = {"r0": 1e16, "r1": 0.6, "r2": 1.0, "r3": 1.0}
    got = evaluate.report(df, "method", digits=300, regime_weights=w, weighting="query").first()
    assert got["weighted_n"] == math.fsum(w.values())


@pytest.mark.parametrize("bins, rounds", [(1024, 2), (4, 3), (2, 1)])
def test_exact_quantiles(spark, monkeypatch, bins, rounds):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "ROUNDS", rounds)
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=400), "one": [3.0], "two": [1.0, 2.0], "same": [7.0] * 50, "ties": rng.integers(0, 4, 90).astype(float), "skew": np.exp(rng.normal(0, 30, 200)),
        "ends": [-1.7e308, 1.7e308, 0.0, 1e-300], "crowd": [0.0] + [1e-9 * k for k in range(60)] + [1e9],
    }
    rows = [(g, i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("none", 0, None), ("one", 1, None), ("two", 2, math.nan)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(4)
    shares = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles.exact_quantiles(df, ["g"], "x", shares).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        with np.errstate(over="ignore"):
            want = np.quantile(np.array(xs, float), shares)
        if g == "ends":
            want, got[g] = want[[0, -1]], [got[g][0], got[g][-1]]  # numpy's own interpolation overflows between
        assert got[g] == pytest.approx(want, rel=1e-12, abs=1e-300), g


def test_no_group_meets_in_one_place(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    plan = quantiles.exact_quantiles(df, ["g"], "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("cells", [1024, 3, 1])
def test_in_ranges(spark, monkeypatch, cells):
    """Ranges that overlap, touch, are open, empty or far apart; against all pairs."""
    monkeypatch.setattr(quantiles, "CELLS", cells)
    rng = random.Random(3)
    ends = [None, -5.0, -1.0, 0.0, 0.25, 0.5, 2.0, 1e6]
    ranges = [(g, k, rng.choice(ends), rng.choice(ends)) for k in range(40) for g in "ab"] + [("c", 0, None, None)]
    rows = [(g, i, x) for i, x in enumerate([None, math.nan, -1e9, -5.0, -1.0, -0.5, 0.0, 0.1, 0.25, 0.4999, 2.0, 1e6, 1e9]) for g in "abcd"]
    left, right = spark.createDataFrame(rows, "g string, i long, x double"), spark.createDataFrame(ranges, "g string, name long, low double, high double")
    got = quantiles.in_ranges(left, "x", right, ["g"])
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((g, i, k) for g, i, x in rows for h, k, low, high in ranges if g == h and x is not None and not math.isnan(x) and (low is None or x >= low) and (high is None or x < high))
    assert sorted((r["g"], r["i"], r["name"]) for r in got.collect()) == want
    assert quantiles.in_ranges(left, "x", right.where("false"), ["g"]).count() == 0


def test_bands(spark):
    points = spark.createDataFrame([("a", [2.0, 1.0, 2.0]), ("b", [0.0])], "g string, p array<double>")
    got = {(r["g"], r["band"]): (r["low"], r["high"]) for r in quantiles.bands(points, ["g"], "p").collect()}
    assert got == {("a", 0): (None, 1.0), ("a", 1): (1.0, 2.0), ("a", 2): (2.0, None), ("b", 0): (None, 0.0), ("b", 1): (0.0, None)}
