r"""Benchmark decontamination: containment search with size-partitioned MinHash sketches, then an exact check.

Items are partitioned by their number of distinct shingles. In a partition where items have at most m shingles,
a document that holds a share t of an item misses at most (1-t)m of them, so of the item's
floor((1-t)m)+1 smallest shingle hashes at least one is in the document: a sketch of that length finds
every such document, however long. Candidates are then verified on the shingles themselves.

Only DataFrame operations are used. (explode_outer, not explode: for the latter the optimizer adds a filter on the
array's size, which computes all shingles again for each word; the joins drop its null rows.) Words are runs of letters and digits, lower-cased; an item of fewer words than
the shingle width is one shingle of all its words.

Edge cases: null, empty or wordless texts and items match nothing; equal documents (id and text) and equal items
give one row; different texts under one id are matched each; null ids are carried along; empty tables give an empty result; other columns are not read (kept by clean()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WIDTH, SHARE = 5, 0.8
#: Rows (some 60 bytes each) up to which item shingles are broadcast; beyond, joins are shuffled.
BROADCAST_ROWS = 200_000

_SPLIT = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPLIT), "")


def _starts(width) -> Column:
    """1-based starts of the shingles of column w; empty if there is none."""
    last = F.size("w") - width + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _strings(width: int) -> Column:
    return F.array_distinct(F.transform(_starts(width), lambda i: F.array_join(F.slice("w", i, width), " ")))


def _hashes(width: int) -> Column:
    return F.transform(_starts(width), lambda i: F.xxhash64(F.lit(width), *(F.get("h", i + (k - 1)) for k in range(width))))


def _widened(width: int) -> Column:
    return F.transform(_strings(width), lambda s: F.struct(F.lit(width).alias("width"), s.alias("shingle")))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, item_key (of id and words), width, shingle, hash and n (distinct shingles of the item)."""
    w = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    parts = [
        w.where(F.size("w") >= k if k == width else F.size("w") == k).select("item_id", F.lit(k).alias("width"), _strings(k).alias("s"))
        for k in range(1, width + 1)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    hashed = F.transform(F.split("shingle", " "), lambda x: F.xxhash64(x))
    out = out.distinct().select("item_id", F.xxhash64("item_id", "width", "s").alias("item_key"), "width", F.size("s").alias("n"), F.explode_outer("s").alias("shingle")).withColumn("h", hashed)
    by_width = F.coalesce(*[F.when(F.col("width") == k, F.xxhash64(F.lit(k), *(F.get("h", F.lit(i)) for i in range(k)))) for k in range(1, width + 1)])
    return out.select("item_id", "item_key", "width", "n", "shingle", by_width.alias("hash"))


def sketches(shingles: DataFrame, share: float = SHARE) -> DataFrame:
    """item_key, hash and need (least number of shingles of a document that can match)."""
    from pyspark.sql import Window

    most = F.pow(2.0, F.floor(F.log2("n")) + 1) - 1  # of the item's size partition
    length = F.floor((1 - share) * most + 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy("item_key").orderBy("hash"))
    return shingles.withColumn("r", rank).where(F.col("r") <= length).select("item_key", "hash", F.ceil(share * F.col("n") - 1e-9).alias("need"))


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """doc_id, text_key, item_id, n_shingles, n_shared, containment of all pairs with containment >= share."""
    shingles = stored(item_shingles(items, width), "items")
    rows = shingles.count()
    near = F.broadcast if rows <= BROADCAST_ROWS else (lambda x: x)
    widths = [r["width"] for r in shingles.select("width").distinct().collect()]  # at most `width` rows
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    if not widths:
        return keyed.join(shingles.limit(0), F.lit(True)).select("doc_id", "text_key", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n").cast("long").alias("n_shared"), F.col("n").cast("double").alias("containment"))
    each = keyed.select("doc_id", "text_key", words("text").alias("w"))
    hashed = each.select("doc_id", "text_key", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    hashed = hashed.select("doc_id", "text_key", F.concat(*[_hashes(k) for k in widths]).alias("x"))
    found = hashed.select("doc_id", "text_key", F.size("x").alias("size"), F.explode_outer("x").alias("hash"))
    found = found.join(near(sketches(shingles, share)), "hash").where("size >= need")
    candidates = stored(found.select("doc_id", "text_key", "item_key").distinct(), "candidates")

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    some = candidates.select("doc_id", "text_key").distinct()
    texts = keyed.join(some, same(keyed, some), "left_semi")
    texts = texts.select("doc_id", "text_key", words("text").alias("w")).distinct()
    parts = texts.select("doc_id", "text_key", F.explode_outer(F.concat(*map(_widened, widths))).alias("x"))
    parts = parts.select("doc_id", "text_key", "x.width", "x.shingle").join(near(shingles), ["width", "shingle"])
    counts = parts.groupBy("doc_id", "text_key", "item_id", "item_key", "n").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= share * F.col("n") - 1e-9)
    sure = counts.join(candidates, same(counts, candidates) & (counts["item_key"] == candidates["item_key"]), "left_semi")
    return sure.select("doc_id", "text_key", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item."""
    bad = matches(docs, items).select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs["text"]) == bad["__bad_key"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, least(len(w), 5) AS k, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, k, s FROM (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k))
SELECT ds.doc_id, bs.item_id, any_value(n.n) AS n_shingles, count(*) AS n_shared, count(*) / any_value(n.n)::DOUBLE AS containment
FROM ds JOIN bs USING (k, s) JOIN n ON n.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
"""
