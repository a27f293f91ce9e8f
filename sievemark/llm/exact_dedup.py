"""Exact dedup by a cuckoo-filter index of live digests.

The index lies in shards by digest. A shard has a cuckoo filter (16-bit fingerprints, four a bucket) and its content: the
whole SHA-256 of each live text in order, which row of it stays and how many there were. A batch of arrivals is combined
before it moves (a digest once per task and CHUNK rows, so copies cost nothing however many there are), dealt to shards, and
there put to the filter some CHUNK rows at a time: a miss is new for certain and goes in; a hit is looked for in
the content by its whole digest, and is a copy if found and new if not. A copy with a larger doc_id takes the place of
the live row. A filter that has no slot left within KICKS moves is built anew from the stored keys with twice the buckets.
delete() takes live rows out of filter and content, so that their texts may come in again.

Memory: a shard's content and arrivals, some SHARD rows of 56 bytes, are in a task at a time; texts never leave the JVM.

Edge cases: null text is empty text; rows that share doc_id and text are copies of each other, of which one stays; a null
doc_id is smaller than all others; an empty table gives an empty result; other columns are kept by without_copies()
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, stored, table, unused

#: Rows a shard should have; rows that are combined or put to the filter at once; shards at least.
SHARD, CHUNK, SHARDS = 100_000, 1 << 16, 32
#: Fingerprints a bucket; moves before a filter counts as full; share of slots that a new filter has filled.
SLOTS, KICKS, LOAD = 4, 200, 0.8
NO_ID = -(1 << 63)
ENTRY = np.dtype([("digest", "S32"), ("id", "<i8"), ("row", "<i8"), ("n", "<i8")])
ARRIVAL = "shard int, data binary"
STATE = "shard int, slots binary, digest binary, keep_id long, keep_row long, group_size long"


class CuckooFilter:
    """Approximate set of digests with deletion. A digest's fingerprint is in one of two buckets, and each of them follows
    from the other and the fingerprint alone, so that fingerprints can move without their digest."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = len(slots) - 1

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket (before the mask) and fingerprint of each digest; 0 marks a free slot and is no fingerprint."""
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        return words[:, 0].astype(np.int64) & 0x7FFFFFFF, (words[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def other(self, bucket, mark):
        return (bucket ^ (mark.astype(np.int64) * 0x5BD1E995)) & self.mask

    def contains(self, digests: np.ndarray) -> np.ndarray:
        first, mark = self.parts(digests)
        first &= self.mask
        second = self.other(first, mark)
        return ((self.slots[first] == mark[:, None]) | (self.slots[second] == mark[:, None])).any(axis=1)

    def insert(self, digests: np.ndarray) -> bool:
        """Whether all went in; if not, the filter is to be built anew from its keys."""
        first, mark = self.parts(digests)
        first &= self.mask
        left = np.arange(len(mark))
        for bucket in (first, self.other(first, mark)):  # free slots: one taker a bucket and turn
            for _ in range(SLOTS):
                _, one = np.unique(bucket[left], return_index=True)
                takers = left[one]
                free = self.slots[bucket[takers]] == 0
                fits = free.any(axis=1)
                self.slots[bucket[takers[fits]], free[fits].argmax(axis=1)] = mark[takers[fits]]
                left = np.setdiff1d(left, takers[fits], assume_unique=True)
        return all(self._kicked(int(first[k]), mark[k]) for k in left)

    def _kicked(self, bucket: int, mark: np.uint16) -> bool:
        for turn in range(KICKS):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return True
            at = turn % SLOTS
            mark, self.slots[bucket, at] = self.slots[bucket, at].copy(), mark
            bucket = int(self.other(bucket, mark))
        return False

    def delete(self, digests: np.ndarray) -> None:
        """Takes out one fingerprint for each digest; all must have been put in."""
        first, mark = self.parts(digests)
        first &= self.mask
        for a, b, m in zip(first, self.other(first, mark), mark, strict=True):
            bucket = a if (self.slots[a] == m).any() else b
            self.slots[bucket, np.flatnonzero(self.slots[bucket] == m)[0]] = 0


def combined(rows: np.ndarray) -> np.ndarray:
    """One entry a digest, in order: the row with the largest doc_id (then row), and how many there are."""
    rows = rows[np.lexsort((rows["row"], rows["id"], rows["digest"]))]
    if not len(rows):
        return rows
    last = np.append(rows["digest"][1:] != rows["digest"][:-1], True)
    ends = np.flatnonzero(last)
    out = rows[ends].copy()
    out["n"] = np.add.reduceat(rows["n"], np.concatenate(([0], ends[:-1] + 1)))
    return out


class Shard:
    """A filter and the content that it stands for."""

    def __init__(self, content: np.ndarray, slots: np.ndarray | None = None):
        self.content = content  # by digest
        self.filter = CuckooFilter(slots) if slots is not None else CuckooFilter.for_keys(len(content))
        if slots is None and len(content):
            self.rebuilt(len(content))

    def rebuilt(self, n: int) -> None:
        """A filter for n keys or more, from the stored ones."""
        self.filter = CuckooFilter.for_keys(n)
        while not self.filter.insert(self.content["digest"]):
            self.filter = CuckooFilter.for_keys(2 * self.filter.slots.size)

    def places(self, digests: np.ndarray) -> np.ndarray:
        """Where each digest is in the content; -1: nowhere. Content is read for hits of the filter only."""
        at = np.full(len(digests), -1)
        hits = np.flatnonzero(self.filter.contains(digests)) if len(self.content) else []
        if len(hits):
            found = np.minimum(np.searchsorted(self.content["digest"], digests[hits]), len(self.content) - 1)
            same = self.content["digest"][found] == digests[hits]
            at[hits[same]] = found[same]
        return at

    def insert(self, batch: np.ndarray) -> None:
        """batch: combined()."""
        at = self.places(batch["digest"])
        copies = at >= 0
        old = self.content[at[copies]]
        both = combined(np.concatenate((old, batch[copies])))
        self.content[np.searchsorted(self.content["digest"], both["digest"])] = both
        new = batch[~copies]
        went = self.filter.insert(new["digest"])
        self.content = np.concatenate((self.content, new))
        self.content = self.content[np.argsort(self.content["digest"], kind="stable")]
        if not went:
            self.rebuilt(max(len(self.content), self.filter.slots.size))

    def delete(self, batch: np.ndarray) -> None:
        """Takes out the digests of which a row of the batch is the live one."""
        rows = np.unique(batch[["digest", "id"]])
        at = self.places(rows["digest"])
        live = at[at >= 0]
        live = live[self.content["id"][live] == rows["id"][at >= 0]]
        self.filter.delete(self.content["digest"][live])
        self.content = np.delete(self.content, live)


@dataclass(frozen=True)
class Index:
    """state has a row with the filter and one with each live digest, for every shard that is not empty."""

    shards: int
    state: DataFrame

    @property
    def keys(self) -> DataFrame:
        return self.state.where("digest is not null").drop("shard", "slots")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, digest binary, row long) of the documents, stored: row tells apart what shares a doc_id."""
    one = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)).alias("digest"))
    return stored(one.withColumn("row", F.monotonically_increasing_id()), "digests")


def _arrivals(rows: DataFrame, shards: int) -> DataFrame:
    """What a task has for a shard, combined and packed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            some = np.zeros(batch.num_rows, ENTRY)
            some["digest"] = np.array(batch.column("digest").to_pylist(), "S32")
            some["id"] = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            some["row"], some["n"] = batch.column("row").to_numpy(zero_copy_only=False), 1
            held.append(some)
            if sum(map(len, held)) >= CHUNK:
                yield dealt(combined(np.concatenate(held)))
                held = []
        if sum(map(len, held)):
            yield dealt(combined(np.concatenate(held)))

    def dealt(some: np.ndarray) -> pa.RecordBatch:
        by = (np.ascontiguousarray(some["digest"]).view("<u8").reshape(-1, 4)[:, 3] % np.uint64(shards)).astype(np.int32)
        order = np.argsort(by, kind="stable")
        some, by = some[order], by[order]
        start = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
        data = [some[a:b].tobytes() for a, b in zip(start, [*start[1:], len(by)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(by[start]), pa.array(data, pa.binary())], names=["shard", "data"])

    return rows.mapInArrow(packed, ARRIVAL)


def _entries(state: pa.Table) -> np.ndarray:
    out = np.zeros(state.num_rows, ENTRY)
    out["digest"] = np.array(state.column("digest").to_pylist(), "S32")
    for name, column in (("id", "keep_id"), ("row", "keep_row"), ("n", "group_size")):
        out[name] = state.column(column).fill_null(NO_ID).to_numpy()
    return out


def _changed(index: Index, rows: DataFrame, how: str) -> Index:
    def change(key: tuple, before: pa.Table, arrivals: pa.Table) -> pa.Table:
        slots = next((x for x in before.column("slots").to_pylist() if x is not None), None)
        content = _entries(before.filter(pa.compute.is_valid(before.column("digest"))))
        shard = Shard(content[np.argsort(content["digest"])], None if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy())
        held: list[np.ndarray] = []
        data = arrivals.column("data").to_pylist()
        for k, x in enumerate(data):
            held.append(np.frombuffer(x, ENTRY))
            if k == len(data) - 1 or sum(map(len, held)) >= CHUNK:
                some = np.concatenate(held)
                getattr(shard, how)(combined(some) if how == "insert" else some)
                held = []
        c, n = shard.content, len(shard.content)
        ids = pa.array(c["id"], mask=c["id"] == NO_ID)
        width = pa.binary(32)
        found = pa.array([c["digest"].tobytes()[32 * k : 32 * k + 32] for k in range(n)], width).cast(pa.binary())
        one = lambda first, rest: pa.concat_arrays([first, rest])
        none = pa.nulls(1, pa.int64())
        return pa.table([
            pa.array(np.full(n + 1, key[0].as_py(), np.int32)), one(pa.array([shard.filter.slots.tobytes()], pa.binary()), pa.nulls(n, pa.binary())),
            one(pa.nulls(1, pa.binary()), found), one(none, ids), one(none, pa.array(c["row"])), one(none, pa.array(c["n"])),
        ], names=["shard", "slots", "digest", "keep_id", "keep_row", "group_size"])

    arrivals = _arrivals(rows, index.shards)
    after = index.state.groupBy("shard").cogroup(arrivals.groupBy("shard")).applyInArrow(change, STATE)
    return Index(index.shards, stored(after, "index"))


def new_index(spark: SparkSession, rows: int) -> Index:
    """An empty index with shards for so many rows."""
    return Index(max(SHARDS, rows // SHARD), spark.createDataFrame([], STATE))


def insert(index: Index, rows: DataFrame) -> Index:
    """The index with digests() of more documents. Of equal texts the row with the largest doc_id is live."""
    return _changed(index, rows, "insert")


def delete(index: Index, rows: DataFrame) -> Index:
    """The index without the digests of which one of rows, digests(), is the live row; rows that had been replaced before
    change nothing."""
    return _changed(index, rows, "delete")


def exact_groups(rows: DataFrame) -> DataFrame:
    """rows, digests() of documents, with keep_id (doc_id of the row that stays), group_size (long) and kept."""
    spark, n = rows.sparkSession, rows.count()
    index = insert(new_index(spark, n), rows)
    several = index.keys.where("group_size > 1")
    found = looked_up(rows, several, "digest", "group_size", n)
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id", "row", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id has; same columns."""
    mark = unused(docs.columns, "kept_row")
    own = stored(docs.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)).alias("digest"), F.col(mark).alias("row"))
    gone = exact_groups(stored(rows, "digests")).where("not kept").select(F.col("row").alias(mark))
    return own.join(gone, mark, "left_anti").select(*docs.columns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digests(table(spark, sf_dir, "documents"))
    return exact_groups(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
