"""Document fingerprints: one-permutation MinHash, optimally densified, stored as packed low-order bits.

A text's word shingles are hashed once. The hash's top bits choose one of BINS bins, which keeps its
smallest hash; an empty bin copies the bin that a fixed hash of (bin, attempt) names first among
those with a value. BITS low bits of each bin are stored. Two fingerprints agree by chance in one of
2**BITS bins, which the estimate takes off.

Edge cases: null, empty and blank texts have the fingerprint of zeros, and a likeness of 1 to each other and of 0 to
all else; fewer words than a shingle make one shingle; equal texts have equal fingerprints wherever they
stand; rows that share a doc_id, or have none, are documents of their own; a byte that is no UTF-8 counts as a code point; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of
from .streams import spans

SHINGLE, BINS, BITS = 5, 256, 4
#: Bytes of text in a range of documents, as long as there are no more than RANGES.
PART, RANGES = 16 << 20, 4096
ATTEMPTS = 2048
MEMORY = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Fingerprints:
    def __init__(self, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS):
        self.shingle, self.bins, self.bits = shingle, bins, bits
        self.hashes = _Hashes()
        self.weights = _mix(np.arange(1, shingle + 1, dtype=np.uint64)) | np.uint64(1)
        grid = np.arange(ATTEMPTS, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)
        self.donors = (_mix(grid + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)
        self.salt = _mix(np.arange(bins, dtype=np.uint64) + np.uint64(0x51ED2701))
        self.shift = np.uint64(64 - (bins - 1).bit_length())

    def values(self, text: bytes | None) -> np.ndarray | None:
        """Low-order bits of each bin; None for a text without words."""
        found = []
        for part in spans(text or b""):
            words = words_of(part)
            if len(self.hashes) > MEMORY:
                self.hashes.clear()
            found.append(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)))
        h = np.concatenate(found)
        if not len(h):
            return None
        k = min(self.shingle, len(h))
        n = len(h) - k + 1
        s = h[:n] * self.weights[0]
        for j in range(1, k):
            s = s + h[j : j + n] * self.weights[j]
        s = np.sort(_mix(s + np.uint64(k)))
        where = (s >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        bins = np.zeros(self.bins, np.uint64)
        full = np.zeros(self.bins, bool)
        full[where[first]] = True
        bins[where[first]] = s[first]
        empty = np.flatnonzero(~full)
        if len(empty):
            source = bins.copy()
            for at in (*range(0, 256, 32), 256):
                tries = self.donors[at : at + 32 if at < 256 else ATTEMPTS, empty]
                hit = full[tries]
                found = hit.any(axis=0)
                bins[empty[found]] = source[tries[hit.argmax(axis=0), np.arange(len(empty))][found]]
                empty = empty[~found]
                if not len(empty):
                    break
            if len(empty):  # practically never: the next full bin
                filled = np.flatnonzero(full)
                bins[empty] = source[filled[np.searchsorted(filled, empty) % len(filled)]]
        # mixed with the bin's number, so that bins with one value agree with others by chance each for itself
        return (_mix(bins + self.salt) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def packed(self, values: np.ndarray | None) -> str:
        """Hexadecimal digits of the bins' bits."""
        if values is None:
            values = np.zeros(self.bins, np.uint8)
        bits = np.unpackbits(values[:, None], axis=1, count=self.bits, bitorder="little")
        return np.packbits(bits.ravel(), bitorder="little").tobytes().hex()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard similarity, less what chance adds."""
        if a is None or b is None:
            return float(a is b)
        chance = 0.5**self.bits
        return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def _bucket(cuts: list[int], x: str) -> tuple[Column, Column]:
    """How many of the sorted cuts are <= x, looked up in two steps: __top, and the count in terms of it."""
    g = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + g] for i in range(0, len(cuts), g)]
    count = lambda array: F.size(F.filter(array, lambda c: c <= F.col(x)))
    top = count(F.array(*[F.lit(v[0]).cast("long") for v in groups]))
    fine = F.array(*[F.array(*[F.lit(c).cast("long") for c in v]) for v in groups])
    inner = F.when(F.col("__top") > 0, (F.col("__top") - 1) * g + count(F.get(fine, F.col("__top") - 1))).otherwise(0)
    return top, inner


def with_next(docs: DataFrame, run, schema: str, part: int = PART) -> DataFrame:
    """Applies run(rows of (doc_id, text, next text)) to docs in ascending doc_id (nulls first, ties by text hash);
    the last document is followed by the first.

    Documents are dealt into ranges of doc_id, of which a copy of the first document also goes to the range before; the
    text is shuffled once. The ranges' bounds, at most RANGES, are doc_ids of documents. A task sorts its range on disk if need be and
    holds two texts of it. Rows that share a doc_id follow one another in the order of a hash of their texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = ["doc_id", "__hash"]
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("least")).first()
    n = max(1, min((size["n"] or 0) // part + 1, size["rows"], RANGES))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []) - {size["least"]})
    head = keyed.orderBy(*order).select("text").first()
    first = head["text"] if head else None
    first = bytes(first) if first is not None else None
    if cuts:
        top, inner = _bucket(cuts, "doc_id")
        keyed = keyed.withColumn("__top", F.coalesce(top, F.lit(0))).withColumn("__in", F.when(F.col("doc_id").isNull(), 0).otherwise(inner))
        is_cut = F.coalesce(F.col("doc_id").isin(cuts), F.lit(False))
        keyed = keyed.withColumn("__copy", F.explode(F.when(is_cut, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    else:
        keyed = keyed.withColumns({"__in": F.lit(0), "__copy": F.lit(0)})
    keyed = keyed.select((F.col("__in") - F.col("__copy")).cast("int").alias("__part"), "doc_id", "__hash", "__copy", "text")
    dealt = keyed.repartitionById(len(cuts) + 1, F.col("__part")).sortWithinPartitions("__part", *order)
    last = len(cuts)

    def pairs(batches):
        held = None
        for b in batches:
            for at, key, _, copy, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[0] == at:
                    yield held[1], held[2], text
                held = (at, key, text) if not copy else None
        if held is not None and held[0] == last:
            yield held[1], held[2], first

    return dealt.mapInArrow(lambda batches: run(pairs(batches)), schema)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of the text with its last quarter replaced by the beginning of the next
    document's, and the likeness of the text to its edit and to the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(rows):
        f = Fingerprints()
        known: tuple = (None, None)
        out = []
        for key, text, after in rows:
            text, after = text or b"", after or b""
            mine = known[1] if known[0] is not None and known[0] == text else f.values(text)
            chars = text.decode(errors="surrogateescape")
            cut = len(chars) // 4
            edited = (chars[: len(chars) - cut] + after[: 4 * cut].decode(errors="surrogateescape")[:cut]).encode(errors="surrogateescape")
            changed, following = f.values(edited), f.values(after)
            known = (after, following)
            out.append((key, len(chars), hashlib.sha256(edited).hexdigest(), f.packed(mine), f.packed(changed), f.likeness(mine, changed), f.likeness(mine, following)))
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return with_next(docs, run, schema)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
