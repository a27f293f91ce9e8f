"""Sums of doubles that are exact until they are rounded once, in any order of rows and on any number of partitions.

A double is at most three integers, each a digit of it in base 2**32 and worth a power of that base. Digits of one place are
summed as longs, which is exact and lets partial sums meet in any order; a sum's digits are joined at the end, carried, and the
leading 62 bits, the last of them set if anything follows, are converted, which rounds half to even. So 1e16, 0.6 and -1e16 make 0.6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32
BASE = 1 << BITS
PLACES = "array<struct<place:int,digit:long>>"


def _scaled(x: Column, power: Column) -> Column:
    """x * 2**power, in three steps as the factor may be no double while the result is one."""
    third = F.floor(power / 3)
    return x * F.pow(F.lit(2.0), third) * F.pow(F.lit(2.0), third) * F.pow(F.lit(2.0), power - 2 * third)


def digits(x: Column) -> Column:
    """The digits of a finite double, with their places; none for 0, null, infinities and nan."""
    place = F.floor(F.log2(F.abs(x)) / BITS).cast("int")  # one too many or few does no harm

    def split(at: Column) -> Column:
        first = _scaled(x, -BITS * at)
        whole = lambda v: v.cast("long")  # noqa: E731  (towards 0)
        second = (first - whole(first)) * float(BASE)
        third = (second - whole(second)) * float(BASE)
        fourth = (third - whole(third)) * float(BASE)
        one = lambda k, v: F.struct((at - k).cast("int").alias("place"), whole(v).alias("digit"))
        return F.filter(F.array(one(0, first), one(1, second), one(2, third), one(3, fourth)), lambda d: d["digit"] != 0)

    usual = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x != 0)
    return F.when(usual, F.transform(F.array(place), split)[0]).otherwise(F.array().cast(PLACES))


def joined(found: Column) -> Column:
    """The double next to the sum of digits: an array of (place, digit), each place once, digits of any size and sign."""
    none = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))

    def of(d: Column) -> Column:
        by_place = F.map_from_entries(d)
        low, high = F.array_min(F.transform(d, lambda e: e["place"])), F.array_max(F.transform(d, lambda e: e["place"]))

        def carried(sign: Column) -> Column:
            def step(a, k):
                v = a["carry"] + sign * F.coalesce(F.element_at(by_place, k), F.lit(0).cast("long"))
                return F.struct(F.shiftright(v, BITS).alias("carry"), F.array_append(a["out"], v.bitwiseAND(F.lit(BASE - 1))).alias("out"))

            return F.aggregate(F.sequence(low, high + 2), none, step)

        plus = carried(F.lit(1).cast("long"))
        negative = plus["carry"] < 0
        places = F.when(negative, carried(F.lit(-1).cast("long"))["out"]).otherwise(plus["out"])
        return F.transform(F.array(places), lambda p: F.when(negative, -1.0).otherwise(1.0) * leading(p, low))[0]

    def leading(p: Column, low: Column) -> Column:
        """The value of digits from 0 to BASE - 1, the first worth BASE ** low."""
        top = F.array_max(F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i) != 0), lambda i: i))

        def at(t: Column) -> Column:
            digit = lambda k: F.coalesce(F.get(p, t - k), F.lit(0).cast("long"))
            bits = F.length(F.bin(digit(0)))
            # 62 bits from the top: all of the first digit, some of the second and third
            rest = lambda v, n: F.when(n <= 0, F.lit(0)).when(n >= BITS, v).otherwise(v.bitwiseAND(_ones(n)))
            lost = F.least(F.lit(BITS), bits + 2)
            second = F.when(bits <= 30, _left(digit(1), 30 - bits)).otherwise(_right(digit(1), bits - 30))
            third = F.when(bits <= 30, _right(digit(2), bits + 2)).otherwise(F.lit(0).cast("long"))
            more = (rest(digit(1), bits - 30) != 0) | (rest(digit(2), lost) != 0) | F.exists(F.slice(p, 1, F.greatest(t - 2, F.lit(0))), lambda v: v != 0)
            number = _left(digit(0), 62 - bits) + second + third
            return _scaled(number.bitwiseOR(more.cast("long")).cast("double"), (BITS * (low + t) + bits - 62).cast("int"))

        return F.coalesce(F.transform(F.array(top), at)[0], F.lit(0.0))

    return F.when(F.size(found) > 0, F.transform(F.array(found), of)[0]).otherwise(F.lit(0.0))


def _left(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n)


def _right(v: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", v, n)


def _ones(n: Column) -> Column:
    return _left(F.lit(1).cast("long"), n) - 1


def exact_sums(rows: DataFrame, by: list[str], values: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """(by, values): for each group the sum of each value over its rows; of (value, times) a row counts times (a long) over. A sum is
    null if all values are, nan or infinite where F.sum is, and the exact sum rounded once otherwise. One shuffle of a few dozen
    sums a group and value, and one to join them."""
    both = {k: v if isinstance(v, tuple) else (v, F.lit(1)) for k, v in values.items()}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("x"), n.cast("long").alias("times")) for k, (v, n) in both.items()))).alias("v")
    long = rows.select(*by, each).select(*by, "v.name", "v.x", "v.times")
    odd = F.when(F.isnan("x") | (F.abs("x") == float("inf")), F.col("x") * F.when(F.col("times") != 0, F.lit(1.0)))
    long = long.select(*by, "name", "times", F.col("x").isNotNull().alias("there"), odd.alias("odd"), F.explode_outer(digits(F.col("x"))).alias("d"))
    sums = long.groupBy(*by, "name", F.col("d.place").alias("place")).agg(F.sum(F.col("d.digit") * F.col("times")).alias("digit"), F.sum("odd").alias("odd"), F.max("there").alias("there"))
    found = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "digit")))
    whole = sums.groupBy(*by, "name").agg(found.alias("found"), F.sum("odd").alias("odd"), F.max("there").alias("there"))
    total = F.when(F.col("there"), F.coalesce("odd", joined(F.col("found"))))
    return whole.withColumn("total", total).groupBy(*by).pivot("name", list(values)).agg(F.first("total"))
