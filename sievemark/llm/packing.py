"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Every task packs its own rows: full sequences are cut from long examples, what remains of them and the
short ones are placed block by block with the dot-product heuristic (of the pieces that fit the open
sequence, the one whose demand has the largest scalar product with what is left of the limits). No
rows move between tasks, so there is no shuffle and no group to be skewed; at most one sequence per
block of up to BLOCK pieces stays short.

Edge cases: null text is empty text (its only token is the end token); empty table, empty result; very
long texts are cut into full sequences, and are encoded in spans between blanks; repeated rows are packed once each; a null
doc_id is carried along; ties go to the earlier piece; only doc_id and text are read, other columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, table
from .streams import PAGE, groups, spans

LENGTH, SEGMENTS, END = 2048, 256, 1
BLOCK = 1024
#: Pieces whose ids a task remembers, and up to how many its worker keeps for later tasks.
CACHE, KEEP = 1 << 20, 450_000


#: What the vocabulary's pre-tokenizer splits by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased UTF-8 bytes, if all that isn't ASCII is a Latin letter.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
#: Neither ASCII nor a Latin letter that lower-cases to one code point and is its own normal form.
FOREIGN = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")


class Memory:
    """Ids of strings that hold no blank, encoded together once and looked up after that."""

    MARK = "\x01"  # stands between strings that are encoded together; it is one token of its own

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        (self.mark,) = tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def learn(self, keys: list[bytes]):
        if odd := {w for w in keys if self.MARK.encode() in w}:
            keys.sort(key=odd.__contains__)
        words = [w.decode().lower() for w in keys] if self.tokenizer.normalizer is None else [w.decode() for w in keys]
        odd = [w for w in words if self.MARK in w]
        plain = words[: len(words) - len(odd)]
        text = [f" {self.MARK} ".join([*plain[i : i + 500], ""]) for i in range(0, len(plain), 500)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
        joined = np.concatenate([*found, np.zeros(0, np.uint32)])
        sizes = np.diff(np.flatnonzero(joined == self.mark), prepend=-1) - 1
        parts = [joined[joined != self.mark]]
        parts += [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in odd]
        sizes = np.concatenate([sizes, [len(x) for x in parts[1:]]]).astype(np.int64)
        new = np.concatenate(parts)
        first, used = len(self.ends) - 1, int(self.ends[-1])
        self.at.update(zip(keys, range(first, first + len(words)), strict=True))
        if used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(max(used, len(new)), np.uint32)])
        self.ids[used : used + len(new)] = new
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])

    def encode(self, split: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of texts that are given as their strings."""
        if len(self.at) > CACHE:
            self.clear()
        count = [len(x) for x in split]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            missing = [words[i] for i in new.tolist()]
            self.learn(list(set(missing)))
            at[new] = [self.at[w] for w in missing]
        start = self.ends[at]
        size = self.ends[at + 1] - start
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        return np.split(ids, np.concatenate(([0], stop))[np.cumsum(count)[:-1]]) if count else []


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space.

    Texts in Latin script are split as the tokenizer does it and only new pieces are encoded; of others, all
    that stands between blanks is encoded once. Blanks always end a token, so the ids are those of the whole
    text either way."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.whole = Memory(whole)
        steps = json.loads(whole.to_str())["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        self.latin = steps[0].get("pattern") == {"Regex": PATTERN}
        if self.latin:
            bare.normalizer = None
            bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.bare = Memory(bare)

    @classmethod
    def of_worker(cls, path: str) -> WordTokens:
        """The one of this process: tasks that a worker runs later start with what it has learned."""
        import tokenizers

        kept = vars(tokenizers).setdefault("_word_tokens", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def trim(self):
        """Forgets what is too much to keep while the worker does other work."""
        for memory in (self.whole, *([self.bare] if self.latin else [])):
            if len(memory.at) > KEEP:
                memory.clear()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; bytes that are no UTF-8 count as U+FFFD."""
        if len(texts) == 1 and len(texts[0]) > PAGE:  # blanks end a token
            return [np.concatenate([self.encode_whole([part])[0] for part in spans(texts[0])])]
        return self.encode_whole(texts)

    def encode_whole(self, texts: list[bytes]) -> list[np.ndarray]:
        texts = [t if t.isascii() else t.decode(errors="replace").encode() for t in texts]
        # a special token's name may stand in a text, and must not arise from lower-casing
        latin = [self.latin and b"<|" not in t and (t.isascii() or not FOREIGN.search(t.decode())) for t in texts]
        fast = iter(self.bare.encode([PIECES.findall(t.translate(LOWER)) for t, ok in zip(texts, latin, strict=True) if ok]) if any(latin) else ())
        slow = iter(self.whole.encode([t.split() for t, ok in zip(texts, latin, strict=True) if not ok]))
        return [next(fast if ok else slow) for ok in latin]


def place(demand: np.ndarray, limits: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, start, length) for pieces with demand (tokens, segments, loss tokens).

    The open sequence takes the fitting piece with the largest scalar product of its demand and the room
    left, both as shares of the limits. If none fits, a piece is cut to fill the room; loss tokens count in
    proportion, rounded up."""
    left = demand.astype(np.float64).copy()
    begin = np.zeros(len(demand), np.int64)
    alive = np.arange(len(demand))
    out: list[list[tuple[int, int, int]]] = []
    while len(alive):
        room = limits.astype(np.float64).copy()
        seq: list[tuple[int, int, int]] = []
        ask = [np.ascontiguousarray(c) for c in left[alive].T]
        gone = np.zeros(len(alive), bool)
        while room[0] >= 1 and room[1] >= 1:
            fits = (ask[0] <= room[0]) & (ask[1] <= room[1]) & (ask[2] <= room[2]) & ~gone
            weight = room / limits**2
            score = np.where(fits, ask[0] * weight[0] + ask[1] * weight[1] + ask[2] * weight[2], -1.0)
            k = int(np.argmax(score))
            if not fits[k]:
                share = np.ceil(room[0] * ask[2] / np.maximum(1, ask[0]))
                cut = np.flatnonzero(~gone & (ask[0] > room[0]) & (ask[1] <= room[1]) & (share <= room[2]))
                if len(cut):
                    i, take, loss = int(alive[cut[0]]), int(room[0]), share[cut[0]]
                    seq.append((i, int(begin[i]), take))
                    begin[i] += take
                    left[i] -= (take, 0, min(loss, left[i, 2]))
                break
            i = int(alive[k])
            seq.append((i, int(begin[i]), int(left[i, 0])))
            room -= left[i]
            gone[k] = True
        if not seq:
            # loss tokens alone keep every piece out: cut the first to what the loss limit allows
            i = int(alive[0])
            take = max(1, int(left[i, 0] * limits[2] // left[i, 2]))
            seq.append((i, int(begin[i]), take))
            begin[i] += take
            left[i] -= (take, 0, np.ceil(take * left[i, 2] / left[i, 0]))
        alive = alive[~gone]
        out.append(seq)
    return out


def pack_rows(rows, length: int, segments: int, loss_limit: int, first: int):
    """rows: (key, ids, loss tokens). Yields (key, start, piece ids, doc tokens, sequence, offset)."""
    limits = np.array([length, segments, loss_limit])
    block, number = [], first

    def flush():
        nonlocal number
        demand = np.array([[len(ids) - at, 1, loss] for _, ids, at, loss in block], float).reshape(-1, 3)
        for seq in place(demand, limits):
            offset = 0
            for i, start, size in seq:
                key, ids, at, _ = block[i]
                yield key, at + start, ids[at + start : at + start + size], len(ids), number, offset
                offset += size
            number += 1
        block.clear()

    for key, ids, loss in rows:
        at = 0
        while len(ids) - at >= length and loss <= loss_limit * (len(ids) // length):
            yield key, at, ids[at : at + length], len(ids), number, 0
            number += 1
            at += length
        if at < len(ids):
            block.append((key, ids, at, int(np.ceil(loss * (len(ids) - at) / len(ids)))))
        if len(block) >= BLOCK:
            yield from flush()
    if block:
        yield from flush()


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, segments: int = SEGMENTS, loss_limit: int | None = None, loss_share: str | None = None, end: int = END) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: path of a tokenizers file. loss_share: column with the share of a row's tokens that bear loss
    (null column: all do). A sequence holds at most length tokens, segments pieces and loss_limit loss tokens."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        words, task = WordTokens.of_worker(vocabulary), TaskContext.get().partitionId()

        def rows():
            for b in batches:
                keys = zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)
                for texts in groups(b.column(1)):
                    for got in words.encode(texts):
                        key, share = next(keys)
                        got = np.append(got, np.uint32(end))
                        yield key, got, int(np.ceil(len(got) * min(max(share, 0.0), 1.0)))

        out = []
        for key, start, ids, size, seq, offset in pack_rows(rows(), length, segments, loss_limit or length, task << 36):
            out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size, seq, offset))
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
        words.trim()

    share = F.coalesce(F.col(loss_share), F.lit(1.0)) if loss_share else F.lit(1.0)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), share.cast("double").alias("share")).mapInArrow(run, fields)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
