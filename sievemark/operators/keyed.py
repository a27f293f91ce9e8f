"""Keyed logs and manifests: resuming, first-wins deduplication, conflicts, upserts, joins that must be complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_do(wanted: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Distinct keys that are wanted and not done."""
    return wanted.select(*key).distinct().join(done, [*key], "left_anti")


def already(wanted: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    return wanted.join(done, [*key], "left_semi")


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    rest = F.struct(*rows.columns)
    return rows.groupBy(*key).agg(F.min_by(rest, F.struct(*order)).alias("r")).select("r.*")


def conflicts(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys with rows that differ, with how many kinds of row."""
    kinds = F.count_distinct(F.xxhash64(*[F.coalesce(F.to_json(F.struct(v)), F.lit("")) for v in values]))
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows"), kinds.alias("n_kinds")).where("n_kinds > 1")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), [*key], "left_anti").unionByName(new, allowMissingColumns=True)


def joined_or_fail(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Inner join in which every left row must find a partner; the job stops at the first that doesn't."""
    marked = right.withColumn("__found", F.lit(True))
    out = left.join(marked, [*key], "left")
    told = F.concat(F.lit("no partner for "), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    return out.where(F.when(F.col("__found"), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).drop("__found")


def joined_complete(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Inner join in which every left row must find a partner; if any doesn't the job stops and says how many distinct keys are missing."""
    missing = left.join(right.select(*key).distinct(), [*key], "left_anti").select(*key).distinct().agg(F.count("*")).scalar()
    told = F.concat(missing.cast("string"), F.lit(" keys are missing"))
    return left.join(right, [*key]).where(F.when(missing == 0, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def resolved(rows: DataFrame, key: list[str], paths: str, manifest: DataFrame) -> DataFrame:
    """(key, digests, unknown) of rows with unique keys and an array of paths: their digests in the manifest (path, digest), in
    order, and the places, from 0, of those that it does not have. A path that very many rows name is looked up by broadcast."""
    each = rows.select(*key, F.posexplode(paths).alias("place", "path"))
    uses = each.groupBy("path").agg(F.count("*").alias("uses"))
    known = manifest.groupBy("path").agg(F.min("digest").alias("digest")).join(uses, "path")
    found = looked_up(each.where("path is not null"), known, "path", "uses", each.count()).select(*key, "place", "digest")
    found = found.unionByName(each.where("path is null").select(*key, "place", F.lit(None).cast("string").alias("digest")))
    lists = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("x"))
    digests = F.transform("x", lambda e: e["digest"])
    unknown = F.transform(F.filter("x", lambda e: e["digest"].isNull()), lambda e: e["place"])
    out = rows.select(*key).join(lists, key, "left")
    none = F.array()
    return out.select(*key, F.coalesce(digests, none.cast("array<string>")).alias("digests"), F.coalesce(unknown, none.cast("array<int>")).alias("unknown"))


def without_partner(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """One row: how many rows of left find no partner (n_rows), and how many distinct keys these have (n_pairs)."""
    gone = left.join(right.select(*key).distinct(), [*key], "left_anti").groupBy(*key).agg(F.count("*").alias("n"))
    return gone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_pairs"))


def complete_groups(left: DataFrame, right: DataFrame, group: str, *key: str) -> DataFrame:
    """Groups of left all of whose rows find a partner."""
    marked = right.select(*key).distinct().withColumn("__found", F.lit(1))
    return left.join(marked, [*key], "left").groupBy(group).agg((F.count("__found") == F.count("*")).alias("ok")).where("ok").select(group)


def manifest_faults(actual: DataFrame, expected: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """Paths that are missing on a side or whose digests differ."""
    a, e = actual.select(path, F.col(digest).alias("have")), expected.select(path, F.col(digest).alias("want"))
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return a.join(e, path, "full").select(path, fault.alias("fault")).where("fault is not null")


#: A key that more than one row in so many has is hot.
HOT = 1000


def looked_up(rows: DataFrame, values: DataFrame, on: str | list[str], weight: str, total: int) -> DataFrame:
    """rows left-joined with values, which have each key once and in weight how many of the total rows have it.

    Keys of more than one row in HOT, so fewer than HOT keys, are broadcast and their rows stay where they are; the others
    are shuffled, with at most one row in HOT a key. Both are read twice; no key is null."""
    often = F.broadcast(values.where(F.col(weight) > total // HOT))
    near = rows.join(often, on)
    rest = rows.join(often.select(on), on, "left_anti").join(values.where(F.col(weight) <= total // HOT), on, "left")
    return near.unionByName(rest)


def map_faults(record: Column, expected: Column) -> Column:
    """What is wrong with a map of settings: every expected key must be there with the same value (null: any), and no other may be."""
    told = lambda keys, what: F.transform(F.array_sort(keys), lambda k: F.concat(k, F.lit(what)))
    both = F.array_intersect(F.map_keys(expected), F.map_keys(record))
    differ = F.filter(both, lambda k: F.element_at(expected, k).isNotNull() & ~F.equal_null(F.element_at(record, k), F.element_at(expected, k)))
    return F.concat(
        told(F.array_except(F.map_keys(expected), F.map_keys(record)), " is missing"), told(F.array_except(F.map_keys(record), F.map_keys(expected)), " is unknown"),
        told(differ, " differs"),
    )
