r"""Language-model scoring by prediction by partial matching, beside a unigram base.

The model is a trie of byte contexts up to ORDER bytes, learned from all training documents. A byte is predicted in the
longest context that the trie has; if it is new there, an escape is coded and the next shorter context is
used, without the symbols already refused (exclusion). The escape gets what the context's occurrences leave
after its own symbols, and DISCOUNT of a count of each of these.

Counts cover every training document, and every gram that occurs LEAST times is in the model, whatever the size of
the corpus. No part of the trie ever meets another one:

1. Each task goes through its texts in chunks. Of a chunk it keeps the texts (compressed) and one message to each
   part of the trie: the chunk's distinct codes (a byte and its context) of that part, with how often training texts
   hold them; words likewise, by hash. Contexts that end with the same LOW bytes make up a part.
2. Parts sum the messages, one after the other, to their share of the trie.
3. Parts read the messages once more, as questions, and answer with probabilities and counts of words.
4. Answers meet their chunk's texts, which are added up symbol by symbol.

Sent to all are only grams of up to LOW bytes, of which there can't be more than 2**24 (some 10,000 in practice). A
task holds one chunk (CHUNK bytes of texts, or one longer text) or one part's distinct codes; messages are streamed.

Texts are scored as lower-cased words joined by single spaces and an end, after an end. Words are compared by
64-bit hashes.

Edge cases: null text is empty text, which is one end token; of an empty or untrained table every byte has
probability 1/256; rows that repeat are scored, and count, once each; rows without doc_id are training rows; texts may
be of any length and of any bytes, valid UTF-8 or not; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .streams import END, PAGE, Hashes, normal

ORDER = 6
#: Grams of up to so many bytes are sent to all; longer ones are in the part of the LOW bytes before their last.
LOW = 3
#: Bytes of training text for each part of the trie; bytes of text after which a chunk ends.
PART, CHUNK = 8 << 20, 24 << 20
#: Longer grams that occur less often are left to the escape.
LEAST = 2
#: What each symbol of a context leaves to the escape.
DISCOUNT = 0.5
#: Logarithms of probabilities travel as multiples of 1 / FINE.
FINE = float(1 << 32)
#: Keys that are held unsorted, and questions that are answered at once.
SOME = 1 << 20
GRAM, WORD, DOCS, PACKED, TEXT = 0, 1, 2, 3, 4

def codes(streams: list[bytes], order: int = ORDER):
    """Codes of the last order + 1 bytes at every symbol of texts, and where each text's symbols begin."""
    lead = END * order
    data = np.frombuffer(b"".join([x for s in streams for x in (lead, s, END)]), np.uint8).astype(np.uint64)
    code = np.zeros(len(data) - order, np.uint64)
    for j in range(order + 1):
        code = code << np.uint64(8) | data[j : j + len(code)]
    sizes = np.array([len(s) + 1 for s in streams], np.int64)
    starts = np.cumsum(sizes) - sizes
    keep = np.repeat(np.arange(len(streams)) * order, sizes) + np.arange(sizes.sum())
    return code[keep], starts


class Trie:
    """Sorted grams of each length, with their counts; contexts with their totals and exclusions."""

    def __init__(self, grams: list[tuple], total: int):
        """grams: for each order the codes (context, then symbol in the lowest byte) and counts, and, where the order
        below may lack them, how often each context occurs, by context; total: all symbols."""
        self.total, self.levels = total, []
        for k, (code, n, *occurs) in enumerate(grams):
            sort = np.argsort(code)
            code, n = code[sort].astype(np.uint64), n[sort].astype(np.float64)
            context = code >> np.uint64(8)
            start = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(code) else np.zeros(0, np.int64)
            names = context[start]
            kept = np.add.reduceat(n, start) if len(start) else np.zeros(0)
            symbols = np.diff(np.append(start, len(code))).astype(np.float64)
            if k == 0:
                seen, refused = np.full(len(start), float(total)), np.zeros(len(start))
            else:
                below = self.levels[-1]
                if occurs:
                    seen = occurs[0].astype(np.float64)
                else:
                    at, there = self.find(below["code"], names)
                    seen = np.maximum(np.where(there, below["n"][at], 0) if len(below["n"]) else 0, kept)
                shorter = self.find(below["code"], code & np.uint64((1 << 8 * k) - 1))[0]
                refused = np.add.reduceat(below["n"][shorter], start) if len(start) else np.zeros(0)
            self.levels.append({"code": code, "n": n, "names": names, "kept": kept, "symbols": symbols, "seen": seen, "refused": refused})

    @staticmethod
    def find(sorted_codes: np.ndarray, x: np.ndarray):
        if not len(sorted_codes):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(sorted_codes, x), len(sorted_codes) - 1)
        return at, sorted_codes[at] == x

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the lowest byte of each code after its other bytes."""
        out = np.zeros(len(code))
        open_ = np.arange(len(code))
        refused, gone = np.zeros(len(code)), np.zeros(len(code))
        for k in range(len(self.levels) - 1, -1, -1):
            t = self.levels[k]
            x = code[open_]
            at, there = self.find(t["names"], x >> np.uint64(8) & np.uint64((1 << 8 * k) - 1))
            gram, hit = self.find(t["code"], x & np.uint64((1 << 8 * k + 8) - 1))
            left = t["symbols"][at] - gone[open_] if len(t["symbols"]) else np.zeros(len(at))
            use = there & ((left > 0) | hit)
            skip = there & ~use  # all its symbols are refused: nothing to code
            refused[open_[skip]], gone[open_[skip]] = (t["refused"][at[skip]], t["symbols"][at[skip]]) if skip.any() else (0, 0)
            if use.any():
                who, at, gram, hit, left = open_[use], at[use], gram[use], hit[use], left[use]
                whole = t["seen"][at] - refused[who]
                part = np.where(hit, t["n"][gram] - DISCOUNT, t["seen"][at] - t["kept"][at] + DISCOUNT * left)
                out[who] += np.log10(np.maximum(part, 1e-9) / np.maximum(whole, 1e-9))
                refused[who], gone[who] = t["refused"][at], t["symbols"][at]
                done = np.zeros(len(code), bool)
                done[who[hit]] = True
                open_ = open_[~done[open_]]
        first = self.levels[0]["symbols"]
        out[open_] -= np.log10(256 - (first[0] if len(first) else 0))
        return out


def page_codes(page: np.ndarray, order: int = ORDER):
    """Codes of the symbols of normal texts, some PAGE at a time."""
    ends = np.flatnonzero(page == END[0])
    starts = np.append(0, ends[:-1] + 1)
    lead = int.from_bytes(END * 8, "big")
    for at in range(0, len(page), PAGE):
        n = min(PAGE, len(page) - at)
        data = page[max(0, at - order) : at + n]
        data = np.concatenate([np.full(n + order - len(data), END[0], np.uint8), data]).astype(np.uint64)
        code = np.zeros(n, np.uint64)
        for j in range(order + 1):
            code <<= np.uint64(8)
            code |= data[j : j + n]
        some = slice(np.searchsorted(starts, at - order), np.searchsorted(starts, at + n))
        for j in range(order):  # before a text there are ends, not the text before it
            where = starts[some] + j
            where = where[(where <= ends[some]) & (where >= at) & (where < at + n)] - at
            own = (1 << 8 * (j + 1)) - 1
            code[where] = code[where] & np.uint64(own) | np.uint64(lead & ~own & ((1 << 8 * (order + 1)) - 1))
        yield code


class Sums:
    """Sorted distinct keys with sums of their counts, which grow as keys come in."""

    def __init__(self):
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw: list = []
        self.size = 0

    def add(self, key: np.ndarray, n: np.ndarray):
        """key need not be sorted or distinct."""
        self.raw.append((key, n))
        self.size += len(key)
        if self.size > SOME:
            self.close()

    def close(self) -> Sums:
        if self.raw:
            key, n = (np.concatenate(x) for x in zip(*self.raw, strict=True))
            self.raw, self.size = [], 0
            self.merge(*merged([(key, n)]))
        return self

    def merge(self, key: np.ndarray, n: np.ndarray):
        """key is sorted and distinct."""
        at = np.searchsorted(self.key, key)
        there = np.zeros(len(key), bool)
        inside = at < len(self.key)
        there[inside] = self.key[at[inside]] == key[inside]
        self.n[at[there]] += n[there]
        self.key = np.insert(self.key, at[~there], key[~there])
        self.n = np.insert(self.n, at[~there], n[~there])


class Marked(Sums):
    """Sums of keys below 2**63 whose count is 1 or 0: sorts faster, as the count is in the key."""

    def add(self, key: np.ndarray, one: np.ndarray):
        super().add(key << np.uint64(1) | one.astype(np.uint64), None)

    def close(self) -> Sums:
        if self.raw:
            key = np.concatenate([k for k, _ in self.raw])
            self.raw, self.size = [], 0
            key.sort()
            start = np.flatnonzero(np.append(True, (key[1:] ^ key[:-1]) > 1))
            ones = np.add.reduceat(key & np.uint64(1), start).astype(np.int64)
            self.merge(key[start] >> np.uint64(1), ones)
        return self


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, highest bytes first: sorted ones compress well this way."""
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _numbers(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    rows = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T
    return np.ascontiguousarray(rows).view(np.dtype(kind).newbyteorder(">"))[:, 0].astype(kind)


def merged(parts):
    """Distinct keys and their summed counts."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, where = np.unique(key, return_inverse=True)
    return key, np.bincount(where, n, len(key)).astype(np.int64)


def receivers(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def owners(code: np.ndarray, parts: int) -> np.ndarray:
    """The part of each code: that of the LOW bytes before its last."""
    return receivers(code >> np.uint64(8) & np.uint64((1 << 8 * LOW) - 1), parts)


def unpacked(data: bytes):
    """Codes, counts, and how often each context occurs, of a PACKED row."""
    n, contexts = np.frombuffer(data, "<i8", 2)
    ends = 16 + 8 * n
    return _numbers(data[16:], "u8", n), _numbers(data[ends:], "i8", n), _numbers(data[ends + 8 * n :], "i8", contexts)


def _shrunk(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level).compress(data)


def _grown(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _message(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys, by their differences, and counts."""
    return _shrunk(_planes(np.diff(key, prepend=np.uint64(0))) + _planes(n.astype(np.uint32)))


def _keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_numbers(data, "u8", n))


def _dealt(by: np.ndarray, parts: int):
    """(part, indices of its items, in their order) for every part that has items."""
    sort = np.argsort(by.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
    cut = np.searchsorted(by[sort], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, sort[cut[p] : cut[p + 1]]


SENT = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])


def messages(rows: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """(chunk, kind, part, n, data, ids) of rows (doc_id, text, asks, trains): what each chunk of texts tells and asks each
    part (GRAM, WORD), its pages of texts that ask (TEXT), and how many texts train (DOCS)."""

    def run(batches):
        hashes, chunk = Hashes(), TaskContext.get().partitionId() << 36
        grams, words, size, number = Marked(), Sums(), 0, 0
        out, out_size = [], 0

        def row(kind, part, n, data, ids=None):
            nonlocal out_size
            out.append({"chunk": chunk, "kind": kind, "part": part, "n": n, "data": data, "ids": ids})
            out_size += len(data)

        def told():
            for kind, sums in ((GRAM, grams), (WORD, words)):
                sums.close()
                by = owners(sums.key, parts) if kind == GRAM else receivers(sums.key, parts)
                for p, some in _dealt(by, parts):
                    row(kind, p, len(some), _message(sums.key[some], sums.n[some]))

        def read(texts, ids, asks, trains):
            page = normal(texts)
            ends = np.flatnonzero(page == END[0])
            at = 0
            for code in page_codes(page, order):
                one = np.ones(len(code), bool) if all(trains) else np.array(trains)[np.searchsorted(ends, np.arange(at, at + len(code)))]
                grams.add(code, one)
                at += len(code)
            for h, where in hashes.of_page(page):
                words.add(h, np.array(trains, np.int64)[np.searchsorted(ends, where)])
            if asks:
                row(TEXT, None, len(ids), _shrunk(page.tobytes(), 3), ids)
            return len(page)

        def flush():
            nonlocal out, out_size
            batch = pa.RecordBatch.from_pylist(out, schema=SENT)
            out, out_size = [], 0
            return batch

        for batch in _pages(batches):
            size += read(*batch)
            number += sum(batch[3])
            if size > CHUNK:
                told()
                chunk, grams, words, size = chunk + 1, Marked(), Sums(), 0
            if out_size > PAGE:
                yield flush()
        if size:
            told()
        if number:
            row(DOCS, 0, number, b"")
        yield flush()

    return rows.select("doc_id", "text", "asks", "trains").mapInArrow(run, "chunk long, kind int, part int, n long, data binary, ids array<long>")


def _pages(batches):
    """(texts, ids, whether they ask, which train): some PAGE bytes of texts, or one longer text."""
    texts, ids, trains, size, asking = [], [], [], 0, None
    for b in batches:
        for k in range(b.num_rows):
            key, text, asks, train = (c[k].as_py() for c in b.columns)
            text = text or b""
            if texts and (size + len(text) > PAGE or asks != asking):
                yield texts, ids, asking, trains
                texts, ids, trains, size = [], [], [], 0
            asking = asks
            texts.append(text)
            ids.append(key)
            trains.append(train)
            size += len(text) + 1
    if texts:
        yield texts, ids, asking, trains


def _by_part(df: DataFrame, key: str, *then: str) -> DataFrame:
    """df by a number, evenly over the partitions and in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.col(key).cast("long")
    number = F.shiftright(number, 36) + number.bitwiseAND(F.lit((1 << 36) - 1))  # a chunk's task, and its place in it
    return df.repartitionById(n, F.pmod(number, F.lit(n)).cast("int")).sortWithinPartitions(key, *then)


COUNTED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("length", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def counts_of(told: DataFrame, order: int = ORDER) -> DataFrame:
    """(part, kind, length, key, n, data) of messages(): for each part a row with its number of tokens (n) and distinct
    words (key) (WORD), its sums of grams of up to LOW bytes (GRAM), for each longer length the grams that occur LEAST
    times, and for length 0 its words (PACKED); and the number of documents (DOCS)."""

    def rows(part, grams, words, number):
        out = []
        key, n = grams.close().key, grams.n
        key, n = key[n > 0], n[n > 0]
        for length in range(order + 1, 0, -1) if len(key) else ():
            if length <= order:
                key, n = merged([(key & np.uint64((1 << 8 * length) - 1), n)])
            if length <= LOW:
                out += [(GRAM, length, k, c, None) for k, c in zip(key.view(np.int64).tolist(), n.tolist(), strict=True)]
            else:
                out.append((PACKED, length, 0, 0, _packed(key, n, length)))
        key, n = words.close().key, words.n
        key, n = key[n > 0], n[n > 0]
        if len(key):
            out += [(WORD, 0, len(key), int(n.sum()), None), (PACKED, 0, 0, len(key), _planes(key) + _planes(n))]
        if number:
            out.append((DOCS, 0, 0, number, None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), *(pa.array(c, f.type) for c, f in zip(columns, list(COUNTED)[1:], strict=True))], schema=COUNTED)

    def run(batches):
        key, grams, words, number = None, Sums(), Sums(), 0
        for b in batches:
            for k in range(b.num_rows):
                part, kind, n, data = (c[k].as_py() for c in b.columns)
                if part != key:
                    if key is not None:
                        yield rows(key, grams, words, number)
                    key, grams, words, number = part, Sums(), Sums(), 0
                if kind == DOCS:
                    number += n
                    continue
                data = _grown(data)
                (grams if kind == GRAM else words).add(_keys(data, n), _numbers(data[8 * n :], "u4", n).astype(np.int64))
        if key is not None:
            yield rows(key, grams, words, number)

    told = told.where(F.col("kind") != TEXT).select("part", "kind", "n", "data")
    return _by_part(told, "part").mapInArrow(run, "part int, kind int, length int, key long, n long, data binary")


def parts_of(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(1, min(1 << 20, size // PART))


def _rows(docs: DataFrame, asks: bool, trains: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.lit(asks).alias("asks"), F.coalesce(trains, F.lit(False)).alias("trains"))


def count_all(docs: DataFrame, order: int = ORDER, parts: int | None = None) -> DataFrame:
    """counts_of() all docs."""
    return counts_of(messages(_rows(docs, False, F.lit(True)), parts or parts_of(docs), order), order)


def _packed(key: np.ndarray, n: np.ndarray, length: int) -> bytes:
    """Grams that occur LEAST times, and the occurrences of their contexts, which count all grams."""
    context = key >> np.uint64(8)
    start = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    occurs, names = np.add.reduceat(n, start), context[start]
    keep = n >= LEAST
    left = np.isin(names, context[keep])
    # only ends before a text make up this context: it occurs in a text where nothing but an end follows
    ends = np.uint64(int.from_bytes(END * (length - 1), "big"))
    for at in np.flatnonzero(names == ends):
        mine = context == ends
        occurs[at] = max(n[mine & (key & np.uint64(0xFF) == END[0])].sum(), n[mine & keep].sum())
    return np.array([keep.sum(), left.sum()], "<i8").tobytes() + _planes(key[keep]) + _planes(n[keep]) + _planes(occurs[left])


def low_grams(counts: DataFrame, order: int = ORDER) -> list[tuple]:
    """Codes and counts of the grams of up to LOW bytes."""
    rows = counts.where(F.col("kind") == GRAM).groupBy("length", "key").agg(F.sum("n").alias("n")).where((F.col("length") < 3) | (F.col("n") >= LEAST)).toArrow()
    length, key, n = (rows.column(c).to_numpy() for c in ("length", "key", "n"))
    return [(key[length == k].view(np.uint64), n[length == k]) for k in range(1, min(LOW, order + 1) + 1)]


def trie_of(low: list[tuple], packed: dict[int, list[bytes]], symbols: int, order: int = ORDER) -> Trie:
    """The trie of the low grams and of parts' PACKED rows by length."""
    grams = list(low)
    for length in range(LOW + 1, order + 2):
        some = [unpacked(x) for x in packed.get(length, [])]
        key, n = (np.concatenate([np.zeros(0, kind), *[x[i] for x in some]]) for i, kind in ((0, np.uint64), (1, np.int64)))
        context = np.concatenate([np.zeros(0, np.uint64), *[np.unique(x[0] >> np.uint64(8)) for x in some]])
        grams.append((key, n, np.concatenate([np.zeros(0, np.int64), *[x[2] for x in some]])[np.argsort(context)]))
    return Trie(grams, symbols)


def train(counts: DataFrame, order: int = ORDER):
    """The whole trie in one place, for small tables, and what totals() gives."""
    tokens, distinct, ends, symbols = totals(counts)
    packed: dict = {}
    for r in counts.where((F.col("kind") == PACKED) & (F.col("length") > 0)).select("length", "data").collect():
        packed.setdefault(r["length"], []).append(bytes(r["data"]))
    return trie_of(low_grams(counts, order), packed, symbols, order), tokens, distinct, ends


def totals(counts: DataFrame):
    """Tokens, distinct tokens, ends among them, and symbols."""
    of_one = F.col("kind").isin(WORD, DOCS) | ((F.col("kind") == GRAM) & (F.col("length") == 1))
    sums = {r["kind"]: r for r in counts.where(of_one).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("key").alias("keys")).collect()}  # three rows
    of = lambda kind, what="n": int(sums[kind][what]) if kind in sums else 0
    ends = of(DOCS)
    return of(WORD) + ends, of(WORD, "keys") + (ends > 0), ends, of(GRAM)


def score_documents(docs: DataFrame, training: DataFrame | Column, order: int = ORDER) -> DataFrame:
    """docs' doc_id with held_out, n_tokens, n_known, train_tokens, base_score and score. training: a table of its own, or
    a condition on docs, which are then read once."""
    own = isinstance(training, Column)
    rows = _rows(docs, True, training) if own else _rows(docs, True, F.lit(False)).union(_rows(training, False, F.lit(True)))
    parts = parts_of(docs.where(training) if own else training)
    sent = stored(messages(rows, parts, order), "messages", by="kind")
    counts = stored(counts_of(sent, order), "counts")
    tokens, distinct, ends, symbols = totals(counts)
    found = _sums(sent.where(F.col("kind") == TEXT), _answers(counts, sent, low_grams(counts, order), symbols, order), parts, order, tokens, distinct, ends)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _answers(counts: DataFrame, sent: DataFrame, low: list[tuple], symbols: int, order: int) -> DataFrame:
    """(chunk, kind, part, data): for each message log10 of the probabilities of its codes, or the counts of its words."""
    shared = counts.sparkSession.sparkContext.broadcast(low)

    class Known:
        """Probabilities of the codes of a part, each worked out once."""

        def __init__(self, trie):
            self.trie, self.key, self.value = trie, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def __call__(self, keys: list[np.ndarray]):
            every = np.unique(np.concatenate(keys))
            at, there = Trie.find(self.key, every)
            new = every[~there]
            if len(new):
                at = np.searchsorted(self.key, new)
                self.key, self.value = np.insert(self.key, at, new), np.insert(self.value, at, np.rint(self.trie.log10(new) * -FINE).astype(np.uint64))
            for key in keys:
                yield _shrunk(_planes(self.value[np.searchsorted(self.key, key)]))

    def run(batches):
        key, packed, known, words, asked, size = None, {}, None, None, [], 0

        def answers():
            out = [{"chunk": chunk, "kind": GRAM, "part": key, "data": data} for (chunk, _), data in zip(asked, known([k for _, k in asked]), strict=True)]
            asked.clear()
            return pa.RecordBatch.from_pylist(out, schema=shape)

        for b in batches:
            for k in range(b.num_rows):
                part, role, chunk, kind, n, data = (c[k].as_py() for c in b.columns)
                if part != key:
                    if asked:
                        yield answers()
                    key, packed, known, words, size = part, {}, None, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
                if role == 0 and kind == 0:
                    words = _numbers(data, "u8", n), _numbers(data[8 * n :], "i8", n)
                elif role == 0:
                    packed.setdefault(kind, []).append(data)
                elif kind == WORD:
                    at, there = Trie.find(words[0], _keys(_grown(data), n))
                    found = np.where(there, words[1][at] if len(words[1]) else 0, 0)
                    yield pa.RecordBatch.from_pylist([{"chunk": chunk, "kind": WORD, "part": part, "data": _shrunk(_planes(found.astype(np.uint64)))}], schema=shape)
                else:
                    if known is None:
                        known, packed = Known(trie_of(shared.value, packed, symbols, order)), {}
                    asked.append((chunk, _keys(_grown(data), n)))
                    size += n
                    if size > SOME:
                        yield answers()
                        size = 0
        if asked:
            yield answers()

    shape = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
    model = counts.where(F.col("kind") == PACKED).select("part", F.lit(0).alias("role"), F.lit(0).cast("long").alias("chunk"), F.col("length").alias("kind"), "n", "data")
    asks = sent.where(F.col("kind").isin(GRAM, WORD)).select("part", F.lit(1).alias("role"), "chunk", "kind", "n", "data")
    return _by_part(model.union(asks), "part", "role").mapInArrow(run, "chunk long, kind int, part int, data binary")


class Table:
    """Values of sorted distinct keys, found through a table of places by hash; keys whose place another took are searched."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.key, self.value = key, value
        self.shift = np.uint64(64 - max(4, int(len(key)).bit_length() + 2))
        self.at = np.zeros(1 << 64 - int(self.shift), np.int32)
        place = self.place(key)
        self.at[place] = np.arange(len(key), dtype=np.int32)
        self.rest = np.flatnonzero(self.at[place] != np.arange(len(key)))
        self.rest_key = key[self.rest]

    def place(self, key: np.ndarray) -> np.ndarray:
        return key * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        at = self.at[self.place(key)]
        lost = np.flatnonzero(self.key[at] != key)
        at[lost] = self.rest[np.searchsorted(self.rest_key, key[lost])]
        return self.value[at]


def _sums(texts: DataFrame, answers: DataFrame, parts: int, order: int, tokens: int, distinct: int, ends: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of texts that ask, from their chunks' pages and answers."""
    whole = tokens + 0.5 * (distinct + 1)
    fields = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def tables(pages, answers, hashes):
        grams, words = Marked(), Sums()
        for page, _ in pages:
            for code in page_codes(page, order):
                grams.add(code, np.zeros(len(code), np.uint64))
            for h, _ in hashes.of_page(page):
                words.add(h, np.zeros(len(h), np.int64))
        out = []
        for kind, key in ((GRAM, grams.close().key), (WORD, words.close().key)):
            by = owners(key, parts) if kind == GRAM else receivers(key, parts)
            value = np.zeros(len(key), np.float64 if kind == GRAM else np.int64)
            for p, some in _dealt(by, parts):
                found = _numbers(_grown(answers.pop((kind, p))), "u8", len(some))
                value[some] = found / -FINE if kind == GRAM else found
            out.append((key, value))
        (code, value), (word, n) = out
        return Table(code, value), Table(word, np.arange(len(word))), np.where(n > 0, np.log10((n + 0.5) / whole), np.log10(0.5 / whole)), n > 0

    def scored(pages, answers, hashes):
        grams, words, cost, known = tables(pages, answers, hashes)
        for page, ids in pages:
            stops = np.flatnonzero(page == END[0])
            score, base = np.zeros(len(ids)), np.full(len(ids), np.log10((ends + 0.5) / whole))
            n_tokens, n_known = np.ones(len(ids), np.int64), np.full(len(ids), int(ends > 0))
            at = 0
            for code in page_codes(page, order):
                first, last = np.searchsorted(stops, [at, at + len(code) - 1])
                starts = np.append(0, stops[first:last] + 1 - at)
                score[first : last + 1] += np.add.reduceat(grams[code], starts)
                at += len(code)
            for h, where in hashes.of_page(page):
                if len(h):
                    which, owner = words[h], np.searchsorted(stops, where)
                    n_tokens += np.bincount(owner, minlength=len(ids))
                    n_known += np.bincount(owner, known[which], len(ids)).astype(np.int64)
                    base += np.bincount(owner, cost[which], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n_tokens, n_known, base, score))], names=[f.split()[0] for f in fields.split(", ")])

    def run(batches):
        hashes, key, pages, answers = Hashes(), None, [], {}
        for b in batches:
            for k in range(b.num_rows):
                chunk, kind, part, data, ids = (c[k].as_py() for c in b.columns)
                if chunk != key:
                    if pages:
                        yield from scored(pages, answers, hashes)
                    key, pages, answers = chunk, [], {}
                if kind == TEXT:
                    pages.append((np.frombuffer(_grown(data), np.uint8), ids))
                else:
                    answers[kind, part] = data
        if pages:
            yield from scored(pages, answers, hashes)

    both = texts.select("chunk", "kind", "part", "data", "ids").unionByName(answers, allowMissingColumns=True)
    return _by_part(both, "chunk").mapInArrow(run, fields)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), ~held_out())
