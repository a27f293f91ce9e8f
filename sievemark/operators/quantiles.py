"""Exact quantiles of any number of groups of any size, and joins of values with ranges, without ordering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a histogram; rounds of them before the values that are left are ordered. Cells that the span of all ranges is cut into.
BINS, ROUNDS, CELLS = 1024, 2, 1024


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, quantiles): the quantiles of a group's values at shares of 0 to 1, interpolated linearly between neighbours; nulls and
    nans are left out, and groups of these only.

    All groups and quantiles are narrowed down together: a histogram of a bracket of values says in which bin the ranks lie that
    are looked for, and that bin's least and largest values are the next bracket. After ROUNDS of that the values still in
    brackets, a BINS**ROUNDS-th of all if they are spread, are ordered; where they are crowded that sort is larger, and spills."""
    found = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("x"))
    places = lambda n: [r for s in shares for r in (F.floor(s * (n - 1)), F.ceil(s * (n - 1)))]
    wanted = F.array(*(F.struct(F.lit(k).alias("slot"), r.cast("long").alias("rank")) for k, r in enumerate(places(F.col("n")))))
    sizes = found.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    brackets = sizes.select(*by, F.lit(0).cast("long").alias("bracket"), "low", "high", wanted.alias("wanted"))
    left = found.withColumn("bracket", F.lit(0).cast("long"))
    for _ in range(ROUNDS):
        # halves, as the width of a bracket may be no double; the same place or a later one for a larger value
        place = F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS)
        bin_ = F.when(F.col("high") > F.col("low"), F.least(place, F.lit(BINS - 1))).otherwise(0).cast("long")
        inside = left.join(brackets.select(*by, "bracket", "low", "high"), [*by, "bracket"])
        left = inside.select(*by, (F.col("bracket") * BINS + bin_).alias("next"), "bracket", "x")
        counts = left.groupBy(*by, "bracket", "next").agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        brackets = _holding(counts, brackets, by, "next").select(*by, F.col("next").alias("bracket"), "low", "high", "wanted")
        left = left.select(*by, F.col("next").alias("bracket"), "x")
    inside = left.join(brackets.select(*by, "bracket"), [*by, "bracket"])
    values = _holding(inside.groupBy(*by, "bracket", "x").agg(F.count("*").alias("c")), brackets, by, "x")
    at = values.select(*by, "x", F.explode("wanted").alias("t")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("t.slot", "x"))).alias("at"))

    def between(k: int, n: Column) -> Column:
        low, high = (F.element_at("at", F.lit(2 * k + j)) for j in (0, 1))
        part = shares[k] * (n - 1) - F.floor(shares[k] * (n - 1))
        return F.when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part))

    return at.join(sizes.select(*by, "n"), by).select(*by, F.array(*(between(k, F.col("n")) for k in range(len(shares)))).alias("quantiles"))


def _holding(counts: DataFrame, brackets: DataFrame, by: list[str], order: str) -> DataFrame:
    """Those of the counted parts of brackets in which wanted ranks lie, with these ranks, counted within the part."""
    before = F.sum("c").over(Window.partitionBy(*by, "bracket").orderBy(order)) - F.col("c")
    here = counts.withColumn("before", before).join(brackets.select(*by, "bracket", "wanted"), [*by, "bracket"])
    mine = F.filter("wanted", lambda t: (t["rank"] >= F.col("before")) & (t["rank"] < F.col("before") + F.col("c")))
    moved = F.transform(mine, lambda t: F.struct(t["slot"].alias("slot"), (t["rank"] - F.col("before")).alias("rank")))
    return here.withColumn("wanted", moved).where(F.size("wanted") > 0)


def in_ranges(rows: DataFrame, value: str, ranges: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of every range (by, low, high) of their group that holds the value: low <= value < high, a null bound
    being open. Rows in no range, or with a null value, go.

    The span of all bounds is cut into CELLS cells; a range is put into each cell that it touches, a value into its own, and the
    two meet by an equi-join on group and cell. What lies outside the span belongs to the outer cells."""
    ends = ranges.agg(F.min(F.least("low", "high")).alias("a"), F.max(F.greatest("low", "high")).alias("b")).first()
    a, b = ends["a"] or 0.0, ends["b"] or 0.0

    def cell(x: Column) -> Column:
        if not b > a:
            return F.lit(0)
        part = (x / 2 - a / 2) / (b / 2 - a / 2) * CELLS
        return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(part))).cast("int")

    first = F.when(F.col("low").isNull(), 0).otherwise(cell(F.col("low")))
    last = F.when(F.col("high").isNull(), CELLS - 1).otherwise(cell(F.col("high")))
    valid = F.coalesce(F.col("low") < F.col("high"), F.lit(True))
    spread = ranges.where(valid).withColumn("__cell", F.explode(F.sequence(first, last)))
    met = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__cell", cell(F.col(value))).join(spread, [*by, "__cell"])
    inside = F.coalesce(F.col(value) >= F.col("low"), F.lit(True)) & F.coalesce(F.col(value) < F.col("high"), F.lit(True))
    return met.where(inside).drop("__cell")


def bands(edges: DataFrame, by: list[str], points: str) -> DataFrame:
    """(by, band, low, high) between the points of an array column, which rise: band 0 lies below all. Equal points leave no band between."""
    known = edges.select(*by, F.array_distinct(F.sort_array(points)).alias("p"))
    every = F.sequence(F.lit(0), F.size("p"))
    band = F.transform(every, lambda k: F.struct(k.alias("band"), F.when(k > 0, F.get("p", k - 1)).alias("low"), F.get("p", k).alias("high")))
    return known.select(*by, F.explode(band).alias("b")).select(*by, "b.band", "b.low", "b.high")
