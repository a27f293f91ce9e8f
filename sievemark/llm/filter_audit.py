r"""Interaction of document filters: what each removes in every order in which they could be applied.

Every document gets a mask with a bit for each filter that it fails; documents are then counted in cells (part, mask, labels).
What a mask does does not depend on the corpus, so masks are unpivoted against the steps of all orders once: a running bit-or
over the steps before says whether the mask has left already, which makes a step remove it, or be redundant for it. Cells are
joined with that long form, conditional sums over the cells of a part give the counts, and a window over all orders of
part and filter gives what the filter removes in total (Shapley's value times the number of orders).

The documents move as (part, mask, digest); copies are found by the digest of the whole text, combined before the shuffle, and
a text that a large share of the rows has is looked up in a broadcast table of HOT rows at most. The long form has 19,200 rows
for five filters, whatever the corpus.

Edge cases: null text is empty text (it fails A only); a null source is the part ''; a null doc_id counts as smaller than all
others; rows that share doc_id and text are no copies of each other; of several labels of a doc_id any that is 1 counts, a null
label doesn't; every part has all orders and steps, with zeros; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, stored, table

#: The filters in the order of their bits.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MOST = 6


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at a text alone: few words, repeated words, capitals, marks."""
    text = F.coalesce(text, F.lit(""))
    n_words = lambda w: F.array_size(w).cast("long")
    few = lambda w: F.when(n_words(w) < 50, 1).otherwise(0)
    repeated = lambda w: F.when(100 * n_words(F.array_distinct(w)) < 65 * n_words(w), 2).otherwise(0)
    of_words = F.transform(F.array(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), lambda w: few(w) + repeated(w))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return of_words + F.when(100 * capitals.cast("long") > 5 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, part: Column) -> DataFrame:
    """(doc_id, part, mask) of every document, all filters counted."""
    own = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)).alias("digest"),
    ), "masks")
    first = own.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    found = looked_up(own, first.where("copies > 1"), "digest", "copies", own.count())
    copy = F.coalesce(F.col("doc_id").isNotNull() & (F.col("unnamed") | (F.col("doc_id") > F.col("least"))), F.lit(False))
    return found.select("doc_id", "part", (F.col("mask") + F.when(copy, COPY).otherwise(0)).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents share what counts."""
    of = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}
    return rows.join(of, "doc_id", "left").withColumns(zero).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def steps(spark: SparkSession, filters: str) -> DataFrame:
    """Masks against the steps of all orders: does the mask fail the step's filter, has it failed one before, this one only."""
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters))))
    long = spark.range(1 << len(filters)).select(F.col("id").cast("int").alias("mask"), orders.alias("filter_order"))
    long = long.select("mask", "filter_order", F.posexplode(F.split("filter_order", "")).alias("step", "filter"))
    bit = F.element_at(F.create_map(*(x for k, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << k)))), F.col("filter"))
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("fails", F.col("mask").bitwiseAND(bit)).withColumn("gone", F.coalesce(F.bit_or("fails").over(before), F.lit(0)) > 0)
    return long.select("mask", "filter_order", (F.col("step") + 1).alias("step"), "filter", (F.col("fails") > 0).alias("fails"), "gone", (F.col("fails") == F.col("mask")).alias("only"))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts for each part, order and step from cells(); filters: a letter for each bit of the mask, at most MOST."""
    if len(filters) > MOST:
        raise ValueError(f"{len(filters)} filters have too many orders; at most {MOST}")
    long = counted.join(F.broadcast(steps(counted.sparkSession, filters)), "mask")
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    fails, gone = F.col("fails"), F.col("gone")
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(fails & F.col("only")).alias("unique_fails"),
        total(fails & ~gone & (F.col("good") == 1)).alias("good_lost"), total(fails & ~gone & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masks(table(spark, sf_dir, "documents"), F.col("source"))
    return audit(cells(rows, table(spark, sf_dir, "labels"))).drop("filter")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text) OR (doc_id IS NOT NULL AND bool_or(doc_id IS NULL) OVER (PARTITION BY text)), false)] AS f
  FROM d LEFT JOIN l USING (doc_id)),
cell AS (SELECT part, good, toxic, f, count(*) AS n FROM m GROUP BY ALL),
o AS (SELECT a || b || c || x || e AS filter_order FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a) ta, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS b) tb, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) tc,
  (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) tx, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS e) te WHERE len(list_distinct([a, b, c, x, e])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
long AS (SELECT part, good, toxic, n, filter_order, step, filter, f[instr('ABCDE', filter)] AS fails, list_sum(list_transform(f, lambda x: x::INT)) AS many,
  len(list_filter(range(1, 6), lambda k: f[k] AND contains(earlier, 'ABCDE'[k]))) > 0 AS gone FROM cell, s),
g AS (SELECT part, filter_order, step, filter, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
  sum(n) FILTER (fails AND many = 1) AS unique_fails, sum(n) FILTER (fails AND NOT gone AND good = 1) AS good_lost, sum(n) FILTER (fails AND NOT gone AND toxic = 1) AS toxic_lost FROM long GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM g
"""
