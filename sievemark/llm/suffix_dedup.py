"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first WINDOW bytes only, most significant digit first, and groups that can no
longer hold a repeat across documents leave after each pass:

1. First digit: GRAM bytes. Only suffixes that start at the smallest gram hash of some window take part, as
   two equal windows have that gram at the same place (winnowing). Grams of one document leave.
2. All that stands around a gram at once: grams whose surroundings are the same wherever they occur need no further
   digit, as all their windows are equal. Surroundings are compared byte by byte within a bucket, and across buckets by
   BLAKE2b digests of 96 bits with a salt that is drawn for each run, so that no text can be made to meet another's.
3. Remaining digits of the other windows, 8 bytes each. Windows that are still equal after the last digit
   are the repeated windows.

Text is shuffled by document bucket once and that exchange is used by all passes; what moves between passes
are packed arrays of hashes and of the bytes around grams with mixed surroundings, reduced per bucket
before they move. A window found in any number of documents is one entry per bucket. Gram hashes travel with as many bytes
as make chance meetings rare at the corpus' size; these, and the number by which surroundings are put in order, cost time,
not correctness.

Edge cases: null text is empty text; texts shorter than the window lose nothing; rows that share a doc_id never
make each other repeats; a null doc_id counts as smaller than all others; an empty table gives an empty
result; all other columns are kept (by cleaned() whatever their names; dedup_windows() adds __sd_ columns).
"""

from __future__ import annotations

import secrets
from hashlib import blake2b
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, total

WINDOW, GRAM = 50, 28
#: Bytes of text in a bucket of documents; windows of a text that are hashed at once (places take 20 bits).
BUCKET, PIECE = 4 << 20, (1 << 20) - 4096
#: A gram that so many buckets share is dealt out by window instead of by gram.
WIDE = 2000
NO_ID = -(1 << 63)


def make_kernels(window: int = WINDOW, gram: int = GRAM, hash_bytes: int = 8, sort_key=None, salt: bytes = b""):
    """The numpy kernels for one window length, as a namespace of functions. sort_key: see dedup_windows(); salt: of digests."""
    reach = window - gram  # a window has reach + 1 grams
    side = reach + gram + reach  # bytes around a gram that its windows cover
    record = np.dtype([("h", "u8"), ("d", "i8"), ("t", "u4"), ("p", "i4"), ("b", "i4"), ("lo", "u1"), ("hi", "u1"), ("x", "u1", (side,))])
    odd = np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(side)
    mask = np.uint64((1 << 8 * hash_bytes) - 1)

    def gram_hashes(data: np.ndarray) -> np.ndarray:
        """Hash of each gram: prefix doubling of polynomial hashes, then a mix so that order is random."""
        h, size, done, out = data.astype(np.uint64) + np.uint64(1), 1, 0, None
        n = len(data) - gram + 1
        while True:
            if gram & size:
                part = h[done : done + n]
                out = part.copy() if out is None else out * odd**np.uint64(size) + part
                done += size
            if size * 2 > gram:
                break
            h = h[:-size] * odd**np.uint64(size) + h[size:]
            size *= 2
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return out

    def anchors(data: np.ndarray):
        """Positions of anchor grams, first and last window (by its start) that each anchors, gram hashes."""
        parts = []
        for base in range(0, len(data) - window + 1, PIECE):
            h = gram_hashes(data[base : base + PIECE + window - 1])
            # ordered by hash, then by place: equal windows agree on their leftmost smallest gram
            low, size = h >> np.uint64(20) << np.uint64(20) | np.arange(len(h), dtype=np.uint64), 1
            while size * 2 <= reach + 1:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if rest := reach + 1 - size:
                low = np.minimum(low[:-rest], low[rest:])
            cut = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            at = (low[cut] & np.uint64((1 << 20) - 1)).astype(np.int64)
            parts.append((at + base, cut + base, np.append(cut[1:], len(low)) - 1 + base, h[at] & mask))
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))

    def text_anchors(texts: list[bytes]):
        for k, t in enumerate(texts):
            if len(t) >= window:
                data = np.frombuffer(t, np.uint8)
                yield k, data, anchors(data)

    def records(k, data, found, keep, doc, key, bucket):
        at, lo, hi, h = (x[keep] for x in found)
        out = np.zeros(len(at), record)
        out["h"], out["d"], out["t"], out["p"], out["b"] = h, doc, key, at, bucket
        out["lo"], out["hi"] = lo - (at - reach), hi - (at - reach)
        padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(reach, np.uint8)])
        x = np.lib.stride_tricks.sliding_window_view(padded, side)[at]
        x[(place < out["lo"][:, None]) | (place >= out["hi"][:, None].astype(np.int64) + window)] = 0  # of no window here
        out["x"] = x
        return out

    def ordered(rec: np.ndarray):
        """A bucket's records by gram, surroundings and document; starts of equal ones, and whether a record's
        document is not the first that has it. (Equal ones that others part are as good as different ones.)"""
        rec = rec[np.lexsort((rec["d"], as_key(rec), rec["h"]))]
        new = np.ones(len(rec), bool)
        new[1:] = (rec["h"][1:] != rec["h"][:-1]) | (rec["lo"][1:] != rec["lo"][:-1]) | (rec["hi"][1:] != rec["hi"][:-1]) | (rec["x"][1:] != rec["x"][:-1]).any(axis=1)
        start = np.flatnonzero(new)
        return rec, start, rec["d"] > rec["d"][start][np.cumsum(new) - 1]

    def digests(rec):
        """Three numbers for the bytes and range of each record, from a salted cryptographic hash."""
        whole = np.concatenate((rec["lo"][:, None], rec["hi"][:, None], rec["x"]), axis=1).tobytes()
        width = side + 2
        found = b"".join(blake2b(whole[at : at + width], digest_size=12, salt=salt).digest() for at in range(0, len(whole), width))
        return np.frombuffer(found, "<u4").reshape(-1, 3)

    def as_key(rec):
        """A number to put surroundings in order by; equal records have equal numbers, others rarely."""
        if sort_key:
            return sort_key(rec)
        h = rec["lo"].astype(np.uint64) * np.uint64(256) + rec["hi"]
        wide = np.zeros((len(rec), -(-side // 8) * 8), np.uint8)
        wide[:, :side] = rec["x"]
        for w in wide.view(np.uint64).T:
            h = (h ^ (h >> np.uint64(29))) * odd + w
        return h ^ (h >> np.uint64(32))

    def radix_groups(rows: np.ndarray) -> np.ndarray:
        """Group number of each row of bytes (-1: no equal row), one 8-byte digit a pass."""
        wide = np.zeros((len(rows), -(-window // 8) * 8), np.uint8)
        wide[:, :window] = rows
        digits = wide.view(np.uint64)
        label = np.full(len(rows), -1, np.int64)
        left, group = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for j in range(digits.shape[1]):
            d = digits[left, j]
            order = np.lexsort((d, group))
            left, group, d = left[order], group[order], d[order]
            new = np.ones(len(left), bool)
            new[1:] = (group[1:] != group[:-1]) | (d[1:] != d[:-1])
            group = np.cumsum(new) - 1
            more = np.bincount(group, minlength=1)[group] > 1
            left, group = left[more], group[more]
        label[left] = group
        return label

    def repeats(rec: np.ndarray):
        """(record, first offset, last offset) of windows that also occur in a document with a smaller id."""
        order = np.lexsort((as_key(rec), rec["h"]))
        rec = rec[order]
        head = np.ones(len(rec), bool)
        head[1:] = rec["h"][1:] != rec["h"][:-1]
        start = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        base = rec[start][group]
        alike = (rec["lo"] == base["lo"]) & (rec["hi"] == base["hi"])
        alike[alike] = (rec["x"][alike] == base["x"][alike]).all(axis=1)
        uniform = np.logical_and.reduceat(alike, start)[group]
        least = np.minimum.reduceat(rec["d"], start)[group]
        whole = np.flatnonzero(uniform & (rec["d"] > least))
        out = [(whole, rec["lo"][whole].astype(np.int64), rec["hi"][whole].astype(np.int64))]
        mixed = np.flatnonzero(~uniform)
        sizes = np.cumsum(rec["hi"][mixed].astype(np.int64) - rec["lo"][mixed] + 1)
        at = 0
        while at < len(mixed):  # whole groups of a gram, about 200,000 windows at a time
            to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 200_000)) + 1
            while to < len(mixed) and rec["h"][mixed[to]] == rec["h"][mixed[to - 1]]:
                to += 1
            some = mixed[at:to]
            at = to
            n = rec["hi"][some].astype(np.int64) - rec["lo"][some] + 1
            who = np.repeat(some, n)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(rec["lo"][some].astype(np.int64), n)
            rows = rec["x"][who[:, None], off[:, None] + np.arange(window)]
            label = radix_groups(rows)
            got = np.flatnonzero(label >= 0)
            if len(got):
                low = np.full(label.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(low, label[got], rec["d"][who[got]])
                got = got[rec["d"][who[got]] > low[label[got]]]
                out.append((who[got], off[got], off[got]))
        return rec, *(np.concatenate(c) for c in zip(*out, strict=True))

    def spans(rec, lo, hi):
        """Byte spans of windows lo to hi around the records' grams."""
        out = np.zeros(len(rec), [("d", "i8"), ("t", "u4"), ("s", "i4"), ("e", "i4")])
        out["d"], out["t"] = rec["d"], rec["t"]
        out["s"] = rec["p"] - reach + lo
        out["e"] = rec["p"] - reach + hi + window
        return out

    def merged(s: np.ndarray) -> np.ndarray:
        """Spans of each text with overlapping ones joined."""
        s = s[np.lexsort((s["s"], s["t"], s["d"]))]
        if not len(s):
            return s
        text = np.concatenate(([0], np.cumsum((s["d"][1:] != s["d"][:-1]) | (s["t"][1:] != s["t"][:-1]))))
        far = np.maximum.accumulate(text << 32 | s["e"])
        new = np.concatenate(([True], (text[1:] << 32 | s["s"][1:]) > far[:-1]))
        start = np.flatnonzero(new)
        out = s[start].copy()
        out["e"] = far[np.append(start[1:], len(s)) - 1] & 0xFFFFFFFF
        return out

    return SimpleNamespace(record=record, text_anchors=text_anchors, records=records, ordered=ordered, digests=digests, repeats=repeats, spans=spans, merged=merged, anchors=anchors, radix_groups=radix_groups)


def dedup_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, whole_chars: bool = False, sort_key=None) -> DataFrame:
    """docs with __sd_kept (binary, what stays of the text), __sd_bytes, __sd_removed and __sd_spans (long).

    whole_chars: keep every code point of which not all bytes are to go, so that what stays is UTF-8. sort_key: numbers for
    records, equal for equal ones, by which they are put in order (None: a hash); any gives the same result."""
    spark = docs.sparkSession
    gram = min(GRAM, max(1, window * GRAM // WINDOW))
    size = total(docs, F.octet_length(text))
    parts = buckets = max(1, size // BUCKET)
    hash_bytes = min(8, (size.bit_length() + 10 + 7) // 8)
    salt = secrets.token_bytes(16)
    dealt = docs.withColumns({
        "__sd_text": F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")),
        "__sd_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)),
        "__sd_bucket": F.pmod(F.xxhash64(doc_id, text), F.lit(buckets)).cast("int"),
    }).drop(text)
    packed = "__sd_bucket int, __sd_data binary"

    def rows_of(bucket_table: pa.Table):
        """Ids, texts and places of a bucket's rows in their order by both, whichever order they come in; the bucket."""
        ids = bucket_table.column("__sd_id").to_numpy()
        texts = bucket_table.column("__sd_text").to_pylist()
        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))] = np.arange(len(ids))
        return ids, texts, place, bucket_table.column("__sd_bucket")[0].as_py()

    def out(pairs):
        at, data = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"__sd_bucket": pa.array(at, pa.int32()), "__sd_data": pa.array(data, pa.binary())})

    def deal(values, by, bucket=None):
        """One row for each receiver: [bucket,] values."""
        if not len(by):
            return []
        order = np.argsort(by, kind="stable")
        values, by = values[order], by[order]
        cut = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
        head = np.array([bucket], "<i8").tobytes() if bucket is not None else b""
        return [(int(by[a]), head + values[a:b].tobytes()) for a, b in zip(cut, [*cut[1:], len(by)], strict=True)]

    short = np.dtype([("h", "u1", (hash_bytes,)), ("m", "u1")])
    entry = np.dtype([("h", "u1", (hash_bytes,)), ("c", "<u4", (3,)), ("d", "<i8"), ("m", "u1")])
    answer = np.dtype([("h", "u1", (hash_bytes,)), ("d", "<i8"), ("m", "u1")])

    def put(kind, h, **fields):
        out = np.zeros(len(h), kind)
        out["h"] = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :hash_bytes]
        for k, v in fields.items():
            out[k] = v
        return out

    def get(kind, part, head=0):
        """Rows of all payloads, their hashes as numbers, and with a head the bucket that each row comes from."""
        data = part.column("__sd_data").to_pylist()
        rows = [np.frombuffer(x, kind, offset=head) for x in data]
        froms = np.repeat([np.frombuffer(x, "<i8", 1)[0] for x in data], [len(r) for r in rows]) if head else None
        rows = np.concatenate(rows)
        h = np.zeros((len(rows), 8), np.uint8)
        h[:, :hash_bytes] = rows["h"]
        return rows, h.view(np.uint64)[:, 0], froms

    def by_part(rows, h, bucket):
        return deal(rows, (h % np.uint64(parts)).astype(np.int64), bucket)

    def of_grams(part, wanted):
        """A bucket's records whose gram is among those wanted (sorted)."""
        k = make_kernels(window, gram, hash_bytes, sort_key, salt)
        ids, texts, place, bucket = rows_of(part)
        rec = [np.zeros(0, k.record)]
        for i, data, found in k.text_anchors(texts):
            at = np.minimum(np.searchsorted(wanted, found[3]), len(wanted) - 1)
            keep = wanted[at] == found[3]
            if keep.any():
                rec.append(k.records(i, data, found, keep, ids[i], place[i], bucket))
        return k, bucket, np.concatenate(rec)

    def first_digit(part: pa.Table) -> pa.Table:
        """Per bucket: each gram, marked if two documents have it."""
        k = make_kernels(window, gram, hash_bytes, sort_key, salt)
        ids, texts, _, bucket = rows_of(part)
        seen_h, seen_d = [], []
        for i, _, (_, _, _, h) in k.text_anchors(texts):
            seen_h.append(h)
            seen_d.append(np.full(len(h), ids[i]))
        if not seen_h:
            return out([])
        h, d = np.concatenate(seen_h), np.concatenate(seen_d)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        several = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
        return out(by_part(put(short, h[start], m=several), h[start], bucket))

    def shared(part: pa.Table) -> pa.Table:
        """Grams of two documents or more go back to their buckets."""
        rows, h, b = get(short, part, 8)
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        n = np.diff(np.append(start, len(h)))
        keep = order[np.repeat((n > 1) | (np.maximum.reduceat(rows["m"][order], start) > 0), n)]
        return out(deal(put(short, h[keep]), b[keep]))

    def around(part: pa.Table, replies: pa.Table) -> pa.Table:
        """For shared grams: digest of what stands around and the first document that has it, per bucket."""
        if not part.num_rows or not replies.num_rows:
            return out([])
        k, bucket, rec = of_grams(part, np.sort(get(short, replies)[1]))
        if not len(rec):
            return out([])
        rec, start, later = k.ordered(rec)
        several = np.logical_or.reduceat(later, start)
        return out(by_part(put(entry, rec["h"][start], c=k.digests(rec[start]), d=rec["d"][start], m=several), rec["h"][start], bucket))

    def compared(part: pa.Table) -> pa.Table:
        """To buckets: the first document that has a gram if all surroundings are alike; else a request for them."""
        rows, h, b = get(entry, part, 8)
        order = np.argsort(h, kind="stable")
        rows, h, b = rows[order], h[order], b[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.append(start, len(h)))
        mixed = (np.minimum.reduceat(rows["c"], start) != np.maximum.reduceat(rows["c"], start)).any(axis=1)
        kind = np.repeat(np.where(mixed, np.where(n > WIDE, 2, 1), 0), n)
        least = np.repeat(np.minimum.reduceat(rows["d"], start), n)
        keep = (kind > 0) | (rows["d"] > least) | (rows["m"] > 0)
        reply = put(answer, h[keep], d=least[keep], m=kind[keep])
        return out(deal(reply, b[keep]))

    def next_digits(part: pa.Table, replies: pa.Table) -> pa.Table:
        """What stands around grams with mixed surroundings, once a bucket; spans that are known to go."""
        if not part.num_rows or not replies.num_rows:
            return out([])
        known, grams, _ = get(answer, replies)
        grams, first = np.unique(grams, return_index=True)
        known = known[first]
        k, bucket, rec = of_grams(part, grams)
        if not len(rec):
            return out([])
        rec, _, later = k.ordered(rec)
        about = known[np.searchsorted(grams, rec["h"])]
        gone = later | (about["m"] == 0) & (rec["d"] > about["d"])
        send = [rec[~gone & (about["m"] == 1)]]
        for one in np.flatnonzero(~gone & (about["m"] == 2)):  # a gram of very many buckets: each window by its own hash
            r = rec[one]
            for o in range(int(r["lo"]), int(r["hi"]) + 1):
                x = rec[one : one + 1].copy()
                x["lo"] = x["hi"] = o
                x["h"] = xxhash.xxh64_intdigest(r["x"][o : o + window].tobytes(), o)
                x["x"][0, :o] = 0
                x["x"][0, o + window :] = 0
                send.append(x)
        send = np.concatenate(send)
        pairs = [(p, b"r" + x) for p, x in by_part(send, send["h"], None)]
        cut = k.merged(k.spans(rec[gone], rec["lo"][gone].astype(np.int64), rec["hi"][gone].astype(np.int64)))
        if len(cut):
            pairs.append((bucket % parts, b"s" + np.array([bucket], "<i8").tobytes() + cut.tobytes()))
        return out(pairs)

    def last_digits(part: pa.Table) -> pa.Table:
        """Spans to remove, for each bucket."""
        k = make_kernels(window, gram, hash_bytes, sort_key, salt)
        rec, pairs = [], []
        for data in part.column("__sd_data").to_pylist():
            if data[:1] == b"s":
                pairs.append((int(np.frombuffer(data, "<i8", 1, 1)[0]), data[9:]))
            else:
                rec.append(np.frombuffer(data, k.record, offset=1))
        if rec:
            rec, who, lo, hi = k.repeats(np.concatenate(rec))
            if len(who):
                order = np.argsort(rec["b"][who], kind="stable")
                bucket, cut = rec["b"][who][order], k.spans(rec[who], lo, hi)[order]
                at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                pairs += [(int(bucket[a]), k.merged(cut[a:b]).tobytes()) for a, b in zip(at, [*at[1:], len(bucket)], strict=True)]
        return out(pairs)

    names = docs.columns
    schema = T.StructType([*docs.select(*[c for c in names if c != text]).schema, T.StructField("__sd_kept", T.BinaryType()), *[T.StructField(f"__sd_{c}", T.LongType()) for c in ("bytes", "removed", "spans")]])

    def apply(part: pa.Table, cuts: pa.Table) -> pa.Table:
        by: dict = {}
        if cuts.num_rows and part.num_rows:
            s = np.concatenate([np.frombuffer(x, [("d", "i8"), ("t", "u4"), ("s", "i4"), ("e", "i4")]) for x in cuts.column("__sd_data").to_pylist()])
            s = s[np.lexsort((s["s"], s["t"], s["d"]))]
            at = np.flatnonzero(np.concatenate(([True], (s["d"][1:] != s["d"][:-1]) | (s["t"][1:] != s["t"][:-1]))))
            by = {(int(s["d"][a]), int(s["t"][a])): s[a:b] for a, b in zip(at, [*at[1:], len(s)], strict=True)}
        kept, sizes, removed, count = [], [], [], []
        if part.num_rows:
            ids, texts, place, _ = rows_of(part)
            for d, t, p in zip(ids.tolist(), texts, place.tolist(), strict=True):
                mine = by.get((d, p))
                sizes.append(len(t))
                if mine is None:
                    kept.append(t)
                    removed.append(0)
                    count.append(0)
                    continue
                delta = np.bincount(mine["s"], minlength=len(t) + 1) - np.bincount(mine["e"], minlength=len(t) + 1)
                gone = np.cumsum(delta[:-1]) > 0
                data = np.frombuffer(t, np.uint8)
                if whole_chars:
                    lead = (data & 0xC0) != 0x80
                    lead[0] = True
                    char = np.cumsum(lead) - 1
                    gone = np.logical_and.reduceat(gone, np.flatnonzero(lead))[char]
                kept.append(data[~gone].tobytes())
                removed.append(int(gone.sum()))
                count.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
        keep = [c for c in names if c != text]
        arrays = [part.column(c) for c in keep] if part.num_rows else [pa.array([], f.type) for f in (part.schema.field(c) for c in keep)]
        return pa.table([*arrays, pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (sizes, removed, count))], names=[f.name for f in schema])

    by_bucket = dealt.groupBy("__sd_bucket")
    back = lambda df, f: df.groupBy("__sd_bucket").applyInArrow(f, packed)
    again = lambda df, f: by_bucket.cogroup(df.groupBy("__sd_bucket")).applyInArrow(f, packed)
    found = back(by_bucket.applyInArrow(first_digit, packed), shared)
    known = back(again(found, around), compared)
    cuts = back(again(known, next_digits), last_digits)
    return by_bucket.cogroup(cuts.groupBy("__sd_bucket")).applyInArrow(apply, schema)


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated windows cut out of text (and n_chars, if there, counted again); same columns."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column is called like an internal one
    out = dedup_windows(docs.toDF(*own.values()), own["doc_id"], own["text"], window, whole_chars=True)
    text = F.when(F.col("__sd_bytes") > F.col("__sd_removed"), F.col("__sd_kept").cast("string")).otherwise(F.lit(""))
    out = out.withColumn(own["text"], text)
    if "n_chars" in own:
        out = out.withColumn(own["n_chars"], F.length(own["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(new).alias(c) for c, new in own.items()])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__sd_bytes").alias("n_bytes"), F.col("__sd_removed").alias("n_removed"), F.col("__sd_spans").alias("n_spans"), F.sha2("__sd_kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * WINDOW}) AS s FROM (SELECT doc_id, x, unnest(range(0, n - {WINDOW - 1})) AS i FROM d WHERE n >= {WINDOW})),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s AND f.first < w.doc_id),
cut AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW}, -1) AS new FROM hit),
run AS (SELECT doc_id, k, min(i) AS a, max(i) + {WINDOW} AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cut) GROUP BY doc_id, k),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS x FROM (
  SELECT r.doc_id, d.x, a, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS p FROM (SELECT doc_id, a, b FROM run UNION ALL SELECT doc_id, n, n FROM d) r JOIN d ON d.doc_id = r.doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
