"""Quality classifier: a byte-level convolutional network in numpy.

Filters over byte windows slide over the whole document; overlapping chunks of two blocks are max-pooled and
the chunks' largest and mean responses give one probability. Training sees a bounded sample of labelled
rows (PER_CLASS of each class, those with the smallest hash of doc_id, of at most LONGEST bytes); inference streams over every
document, whole, in the tasks that read them: no shuffle.

Edge cases: null text is empty text, which has a score like any other (that of the biases); a text may be of
any length; repeated rows get equal scores; unlabelled, null-labelled and contradictory rows of labels teach
nothing (of repeated labels the smallest counts); without rows of both classes all scores are the share of
label 1 (0.5 if there is none); an empty table gives an empty result; texts may hold any bytes; columns of docs may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import received, shipped, table, unused
from .streams import groups

#: Bound of the training sample: rows of each class.
PER_CLASS = 1500
#: Longer texts are not learned from.
LONGEST = 1 << 18
WIDTH, STRIDE, FILTERS, BLOCK = 8, 4, 16, 256
EPOCHS, BATCH, RATE, SEED = 20, 64, 0.02, 7
#: Share of label-1 rows of which a short run of words is learned as well, and its most words: so that a short
#: text is not taken for a poor one. (Parts of label-0 texts may be good, so these are learned whole only.)
FRAGMENTS, FRAGMENT = 0.15, 24
#: Bytes of texts that are laid out at once (or one longer text), and blocks that are convolved at once.
AT_ONCE, BLOCKS = 1 << 20, 1024


def lay_out(texts: list[bytes]):
    """Texts in blocks, each text followed by at least WIDTH zero bytes; first block of each."""
    blocks = np.array([(len(t) + WIDTH + BLOCK - 1) // BLOCK for t in texts], np.int64)
    first = np.cumsum(blocks) - blocks
    data = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, np.uint8)
    for at, t in zip(first * BLOCK, texts, strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return data, first, blocks


def responses(data: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """(blocks, positions, FILTERS): the filters are tables of byte weights for each place of the window."""
    n = (len(data) - WIDTH) // STRIDE
    out = filters[0][data[: n * STRIDE : STRIDE]]
    for j in range(1, WIDTH):
        out += filters[j][data[j : j + n * STRIDE : STRIDE]]
    return out.reshape(-1, BLOCK // STRIDE, FILTERS)


def pooled(top: np.ndarray, first: np.ndarray, blocks: np.ndarray):
    """Largest response of each document, mean over its overlapping chunks, and the chunks."""
    nxt = np.minimum(np.arange(len(top)) + 1, np.repeat(first + blocks - 1, blocks))
    chunk = np.maximum(top, top[nxt])
    chunks = np.maximum(blocks - 1, 1)
    last = first + blocks - 1
    total = np.add.reduceat(chunk, first, axis=0)
    total[blocks > 1] -= chunk[last[blocks > 1]]  # the last block has no successor and is no chunk of its own
    return np.maximum.reduceat(top, first, axis=0), total / chunks[:, None], nxt


class ByteNet:
    def __init__(self, prior: float = 0.5):
        rng = np.random.default_rng(SEED)
        self.filters = rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.filters[:, 0] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.shift = np.float32(np.log(prior / (1 - prior)))
        self.trained = False

    def forward(self, texts: list[bytes]):
        data, first, blocks = lay_out(texts)
        z = responses(data, self.filters)
        z[first + blocks - 1, BLOCK // STRIDE - (WIDTH - 1) // STRIDE :] = 0  # windows of padding that reach into the next text
        top = np.maximum(z.max(axis=1) + self.bias, 0)
        largest, mean, nxt = pooled(top, first, blocks)
        feats = np.concatenate([largest, mean], axis=1)
        return 1 / (1 + np.exp(-np.clip(feats @ self.out + self.shift, -30, 30))), feats, z, top, nxt, data, first, blocks

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """What forward() gives, with the convolutions of some BLOCKS blocks at a time."""
        if not self.trained or not texts:
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        data, first, blocks = lay_out(texts)
        last, top = first + blocks - 1, np.empty((int(blocks.sum()), FILTERS), np.float32)
        for at in range(0, len(top), BLOCKS):
            z = responses(data[at * BLOCK : (at + BLOCKS) * BLOCK + WIDTH], self.filters)
            z[last[np.searchsorted(last, at) : np.searchsorted(last, at + len(z))] - at, BLOCK // STRIDE - (WIDTH - 1) // STRIDE :] = 0
            top[at : at + BLOCKS] = np.maximum(z.max(axis=1) + self.bias, 0)
        largest, mean, _ = pooled(top, first, blocks)
        p = 1 / (1 + np.exp(-np.clip(np.concatenate([largest, mean], axis=1) @ self.out + self.shift, -30, 30)))
        return np.round(p.astype(np.float64), 6)

    def gradients(self, texts: list[bytes], labels: np.ndarray):
        p, feats, z, top, nxt, data, first, blocks = self.forward(texts)
        g = ((p - labels) / len(labels)).astype(np.float32)
        d_out = feats.T @ g
        owner = np.repeat(np.arange(len(texts)), blocks)
        own_max = feats[owner, :FILTERS]
        d_top = np.where(top == own_max, g[owner, None] * self.out[:FILTERS], 0)
        at = np.arange(len(top))
        is_chunk = (at != np.repeat(first + blocks - 1, blocks)) | np.repeat(blocks == 1, blocks)
        d_chunk = g[owner, None] * self.out[FILTERS:] / np.maximum(blocks - 1, 1)[owner, None] * is_chunk[:, None]
        mine = top >= top[nxt]
        d_top += np.where(mine, d_chunk, 0)
        np.add.at(d_top, nxt, np.where(mine, 0, d_chunk))
        d_top *= top > 0
        pos = z.argmax(axis=1) * STRIDE + (at * BLOCK)[:, None]
        d_filters = np.empty_like(self.filters)
        for j in range(WIDTH):
            d_filters[j] = np.bincount((data[pos + j].astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), d_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        d_filters[:, 0] = 0
        return [d_filters, d_top.sum(axis=0), d_out, g.sum()]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> ByteNet:
        """Adam over shuffled batches; classes weigh alike as the sample is balanced by rows."""
        rng = np.random.default_rng(SEED)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.filters, self.bias, self.out, np.float32(0))]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            rate = RATE * (1 - epoch / epochs) + RATE * 0.05
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                step += 1
                grads = self.gradients([texts[i] for i in some], labels[some])
                for k, (name, grad) in enumerate(zip(("filters", "bias", "out", "shift"), grads, strict=True)):
                    m, v = state[k]
                    state[k] = m, v = [0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad]
                    new = getattr(self, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                    setattr(self, name, new.astype(np.float32))
        self.trained = True
        return self


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ByteNet:
    """A network for labels.quality, from at most per_class labelled rows of docs a class that aren't held out."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by_hash = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = F.broadcast(by_hash(0).union(by_hash(1)))  # at most 2 * per_class rows
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).where(F.octet_length("text") <= LONGEST).join(chosen, "doc_id")
    rows = rows.select("doc_id", "quality", "text").orderBy("doc_id", "text").limit(2 * per_class).collect()
    y = np.array([r["quality"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return ByteNet(min(max(float(y.mean()), 0.001), 0.999) if len(y) else 0.5)
    few, many = sorted((np.flatnonzero(y == 0), np.flatnonzero(y == 1)), key=len)
    again = np.concatenate([np.resize(few, len(many)), many])
    texts, rng = [bytes(rows[i]["text"]) for i in again], np.random.default_rng(SEED)
    parts = []
    for i in np.flatnonzero(y == 1):
        if rng.random() < FRAGMENTS:
            words = bytes(rows[i]["text"]).split(b" ")
            size = int(rng.integers(2, FRAGMENT + 1))
            at = int(rng.integers(0, max(1, len(words) - size)))
            parts.append(b" ".join(words[at : at + size]))
    return ByteNet().fit(texts + parts, np.concatenate([y[again], np.ones(len(parts), np.float32)]))


def with_score(docs: DataFrame, net: ByteNet, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column, the probability of quality 1; its name is out, or unused(out) if docs have that."""
    out = unused(docs.columns, out)
    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    own = unused(docs.columns, "text_bytes")
    sent = shipped(docs.sparkSession, net)  # some 130 kB

    def run(batches):
        model = received(sent)
        for b in batches:
            at = b.schema.get_field_index(own)
            found = [model.scores(some) for some in groups(b.column(at), AT_ONCE)]
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64())], names=schema.names)

    return docs.withColumn(own, F.col(text).cast("binary")).mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
