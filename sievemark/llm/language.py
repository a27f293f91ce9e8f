"""Language identification as a mixture: each word of a document comes from one of several languages.

Words get a likelihood in each language from their byte n-grams. Expectation-maximisation estimates a document's
language proportions; languages join its set one by one as long as the likelihood, less a penalty per
language that grows with the logarithm of the number of words, rises. The prediction is the language
with the largest share of the selected set.

n-gram statistics come from at most PER_LANGUAGE rows and SAMPLE bytes of each language (the rows with the smallest hash of
doc_id, without those longer than LONGEST and held-out ones). Every language of the training rows is learned; if there are more than
FULL, their n-gram tables are smaller, so that the model stays within FULL MB. Documents are scored whole in the tasks that
read them, without a shuffle; of a long text the distinct words are held.

Edge cases: texts that are null or have no letter get `und` with score 0; so do all texts if nothing could be learned;
rows that repeat get equal predictions; an empty table gives an empty result; bytes that are no UTF-8 are no letters; columns
of docs may have any names (new ones are then called by unused()).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, received, shipped, stored, table, unused
from .streams import groups, spans

#: Bounds of the training sample.
PER_LANGUAGE, SAMPLE, LONGEST = 800, 16 << 20, 1 << 20
#: Languages that get tables of 2**BITS slots.
FULL = 64
ORDERS, BITS = (1, 2, 3, 4), 16
ROUNDS, PENALTY, AT_ONCE = 12, 1.0, 1 << 19
_LETTER = regex.compile(r"\p{L}")
#: Bytes that end a word: white space, digits and ASCII punctuation.
_BREAK = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_APART = bytes(32 if _BREAK[b] else LOWER[b] for b in range(256))


def slots(text: bytes, bits: int = BITS):
    """Table slots of all n-grams, one row per order, with the byte at which each ends; words' starts.

    text begins and ends with a break. Runs of breaks count as one; an n-gram is of one word and the break before or after it."""
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    stop = _BREAK[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(stop[1:] & stop[:-1])
    data = np.where(stop, 32, data)[keep].astype(np.uint32)
    at = np.flatnonzero(data == 32)
    since = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    before = np.concatenate(([0], since[:-1]))
    code, found = np.zeros(len(data), np.uint32), []
    for n in ORDERS:
        code[n - 1 :] = code[n - 1 :] + np.left_shift(data[: len(data) - n + 1], np.uint32(8 * (n - 1)))
        inside = np.where(since == 0, before >= max(1, n - 2), since >= n - 1)
        inside[: n - 1] = False
        slot = (code * np.uint32(2654435761) ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) >> np.uint32(32 - bits)
        where = np.flatnonzero(inside)
        found.append((where, slot[where]))
    return found, at, since, data


class Languages:
    def __init__(self, names: list[str]):
        self.names = names
        self.bits = BITS - max(0, -(-len(names) // FULL) - 1).bit_length()
        self.log = np.zeros((len(names), len(ORDERS), 1 << self.bits), np.float32)
        #: Bytes of texts for which likelihoods of words are held at once.
        self.at_once = max(1 << 12, AT_ONCE * 8 // max(8, len(names)))

    def fit(self, texts: list[list[bytes]]) -> Languages:
        """texts: those of each language."""
        for k, some in enumerate(texts):
            counts = np.full((len(ORDERS), 1 << self.bits), 0.02)
            for at in range(0, len(some), 200):
                for j, (_, slot) in enumerate(slots(b" " + b" ".join(some[at : at + 200]) + b" ", self.bits)[0]):
                    counts[j] += np.bincount(slot, minlength=1 << self.bits)
            self.log[k] = np.log(counts / counts.sum(axis=1, keepdims=True))
        return self

    def word_scores(self, texts: list[bytes]):
        """Log-likelihood of each word in each language; number of words of each text."""
        joined = b" ".join([b"", *texts, b""])
        found, at, _, data = slots(joined, self.bits)
        owner = np.zeros(len(data), np.int64)
        owner[at[1:]] = 1  # a break belongs to the word before it
        owner = np.concatenate(([0], np.cumsum(owner)[:-1])) if len(data) else owner
        words = max(1, len(at) - 1)
        total = np.zeros((len(self.names), words))
        for j, (where, slot) in enumerate(found):
            who = np.minimum(owner[where], words - 1)
            for k in range(len(self.names)):
                total[k] += np.bincount(who, self.log[k, j][slot], words)
        return total / len(ORDERS)

    def predict(self, texts: list[bytes]):
        """(language index or -1, its share) of each text, whole."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(texts) == 1 and len(texts[0]) > self.at_once:
            return self.predict_long(texts[0])
        counts = np.array([_words(t) for t in texts])
        score = self.word_scores([t for t, c in zip(texts, counts, strict=True) if c])
        some = np.flatnonzero(counts)
        lang, share = np.full(len(texts), -1), np.zeros(len(texts))
        if len(some) and len(self.names):
            lang[some], share[some] = self.mixtures(score, counts[some])
        return lang, share

    def predict_long(self, text: bytes):
        """predict() of one text, from its distinct words and how often each occurs."""
        seen: Counter = Counter()
        for part in spans(text, self.at_once):
            seen.update(part.translate(_APART).split())
        if not seen or not self.names:
            return np.full(1, -1), np.zeros(1)
        words, some, size, score = list(seen), [], 0, []
        for k, w in enumerate(words):
            some.append(w)
            size += len(w) + 1
            if size >= self.at_once or k == len(words) - 1:
                score.append(self.word_scores(some))
                some, size = [], 0
        times = np.fromiter(seen.values(), np.float64, len(seen))
        return self.mixtures(np.concatenate(score, axis=1), np.array([len(words)]), times)

    def mixtures(self, score: np.ndarray, counts: np.ndarray, times: np.ndarray | None = None):
        """All documents at once: score (languages, words), words of each document, how often each occurs (once)."""
        times = np.ones(score.shape[1]) if times is None else times
        total = np.add.reduceat(times, np.cumsum(counts) - counts)
        n, first = len(self.names), np.cumsum(counts) - counts
        like = np.exp(np.maximum(score - score.max(axis=0), -60.0))
        docs = len(counts)
        chosen = np.zeros((n, docs), bool)
        best = np.full(docs, -np.inf)
        share = np.zeros((n, docs))
        active = np.arange(docs)
        for size in range(1, n + 1):
            # the language to add is the one that a fresh mixture of all would weigh most
            if size == 1:
                weight = np.add.reduceat(np.log(np.maximum(like, 1e-26)) * times, first, axis=1)
            else:
                mixed = (np.repeat(share, counts, axis=1) * like).sum(axis=0)
                weight = np.add.reduceat(like * (times / np.maximum(mixed, 1e-26)), first, axis=1)
            weight[chosen] = -np.inf
            trial = chosen.copy()
            trial[weight[:, active].argmax(axis=0), active] = True
            new, value = self.maximise(like, trial, counts, first, times, total)
            value -= PENALTY * size * np.log(total + 1.0)
            better = active[value[active] > best[active]]
            chosen[:, better] = trial[:, better]
            share[:, better] = new[:, better]
            best[better] = value[better]
            active = better
            if not len(active):
                break
        lang = share.argmax(axis=0)
        return lang, share[lang, np.arange(docs)]

    @staticmethod
    def maximise(like, allowed, counts, first, times=1.0, total=None):
        """Proportions of the allowed languages and the log-likelihood, by ROUNDS rounds of EM."""
        total = counts if total is None else total
        share = allowed / allowed.sum(axis=0)
        if (allowed.sum(axis=0) == 1).all():
            rounds = 0
        else:
            rounds = ROUNDS
        for _ in range(rounds):
            part = np.repeat(share, counts, axis=1) * like
            part *= times / np.maximum(part.sum(axis=0), 1e-26)
            share = np.add.reduceat(part, first, axis=1) / total
        mixed = (np.repeat(share, counts, axis=1) * like).sum(axis=0)
        return share, np.add.reduceat(np.log(np.maximum(mixed, 1e-26)) * times, first)


def _words(text: bytes) -> int:
    """Runs of bytes that are no breaks."""
    stop = np.concatenate(([True], _BREAK[np.frombuffer(text, np.uint8)]))
    return int((stop[:-1] & ~stop[1:]).sum())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Languages:
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    sizes = known.select("lang", "doc_id", F.octet_length("text").cast("long").alias("size"), F.xxhash64("doc_id").alias("h")).where(F.col("size") <= LONGEST)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    some = sizes.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= per_language)  # cut before the shuffle, too
    some = some.groupBy("lang", "rank", "doc_id").agg(F.sum("size").alias("size")).withColumn("sum", F.sum("size").over(Window.partitionBy("lang").orderBy("rank")))
    ids = stored(some.where(F.col("sum") <= SAMPLE).select("lang", "doc_id"), "sample")  # per_language rows each
    rows = known.where(F.octet_length("text") <= LONGEST).select("doc_id", "lang", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), ["doc_id", "lang"])
    texts: dict[str, list[bytes]] = {r["lang"]: [] for r in known.select("lang").distinct().collect()}
    for r in rows.orderBy("doc_id", "text").toLocalIterator():
        texts[r["lang"]].append(bytes(r["text"]))
    return Languages(sorted(texts)).fit([texts[k] for k in sorted(texts)])


def with_language(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    names = [unused(docs.columns, "lang_pred"), unused(docs.columns, "score")]
    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema
    own = unused(docs.columns, "text_bytes")
    sent = shipped(docs.sparkSession, model)  # tables of n-gram slots, at most FULL MB

    def run(batches):
        model = received(sent)
        names = [*model.names, "und"]
        for b in batches:
            at = b.schema.get_field_index(own)
            langs, shares = [], [np.zeros(0)]
            for some in groups(b.column(at), model.at_once):
                lang, share = model.predict([t if lettered(t) else b"" for t in some])
                langs += [names[i] for i in lang]
                shares.append(share)
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(np.concatenate(shares), pa.float64())], names=schema.names)

    return docs.withColumn(own, F.col(text).cast("binary")).mapInArrow(run, schema)


def lettered(text: bytes) -> bool:
    return any(_LETTER.search(part.decode(errors="ignore")) for part in spans(text))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = with_language(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
