"""SimHash near-duplicates: exact search for fingerprints within a Hamming radius, by tiles.

Edge cases: null, empty and blank texts have fingerprint 0 and link like any other; fewer words than a
shingle give one shingle of all words; repeated rows count once for the search and each get their row
back; rows without doc_id keep a fingerprint, take part in no link and get a null component; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored, table, unused, words_of
from .streams import END, Hashes, groups, normal, powers, spans

SHINGLE, SEED, RADIUS = 4, 42, 4
#: The 64 bits are counted in so many equal parts; a tile holds fingerprints with equal counts.
PARTS = 4
TILE = 4096
#: What near copies share (Jaccard, of shingles of WIDTH words).
WIDTH, SHARE = 5, 0.8
#: Texts that share just so much differ in some 39 of BITS bits (deviation 6; 48 for texts of five shingles) and in 19 of
#: the first 128, so at most 1 in 100,000 is beyond these radii; unrelated ones differ in 128 (deviation 8).
BITS, RADIUS_WIDE, RADIUS_FIRST = 256, 76, 46
#: Fingerprints in a tile; of tiles that bring their shingles, most texts and most shingles.
TILE_WIDE, TILE_ROWS, TILE_SETS = 8192, 1024, 1 << 19


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64 values."""
    digest, counts, n, before = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for part in spans(text or b""):
        words = before + words_of(part)
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends[:-1]]
            h = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
            for at in range(0, len(h), 4096):
                bits = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.uint32)
            n += len(h)
        before = words[max(0, len(words) - shingle + 1) :]
    if not n:
        return digest(b" ".join(before), seed) if before else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "simhash") -> DataFrame:
    """docs with a long column that holds the fingerprint's bits; its name is out, or unused(out) if docs have that."""
    out = unused(docs.columns, out)
    schema = docs.select("*", F.lit(0).cast("long").alias(out)).schema
    own = unused(docs.columns, "text_bytes")

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(own)
            prints = np.array([simhash(t.as_py()) for t in b.column(at)], np.uint64).view(np.int64)
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(prints)], names=schema.names)

    return docs.withColumn(own, F.col(text).cast("binary")).mapInArrow(run, schema)


def _cell(fp: str):
    """Bit counts of the parts as one number in base 17."""
    width = 64 // PARTS
    mask = F.lit((1 << width) - 1).cast("long")
    out = F.lit(0)
    for p in range(PARTS):
        out = out * (width + 1) + F.bit_count(F.shiftrightunsigned(F.col(fp), width * p).bitwiseAND(mask))
    return out.cast("int")


def _steps(radius: int) -> list[list[int]]:
    """All changes of the parts' bit counts that differ by at most radius in sum."""
    out = [[]]
    for _ in range(PARTS):
        out = [[*x, d] for x in out for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return out


def spanning(u: np.ndarray, v: np.ndarray):
    """The same components with at most one link a node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _compare(radius: int):
    def links(a, ia, b, ib, same):
        """For each tile pair: one link per fingerprint and group that it joins, not one per pair."""
        left, right = [], []
        rows = max(1, (1 << 17) // max(1, len(b)))
        for at in range(0, len(a), rows):
            near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
            x, y = np.nonzero(near)
            x += at
            if same:
                keep = x < y
                x, y = x[keep], y[keep]
            if not len(x):
                continue
            left.append(ia[x])
            right.append(ib[y])
            if sum(map(len, left)) > 4 * (len(a) + len(b)):
                u, v = spanning(np.concatenate(left), np.concatenate(right))
                left, right = [u], [v]
        return spanning(np.concatenate(left), np.concatenate(right)) if left else (ia[:0], ib[:0])

    def run(batches):
        home = key = None
        for b in batches:
            u, v = [], []
            prints, owners = b.column("fps"), b.column("ids")
            starts = prints.offsets.to_numpy()
            prints, owners = prints.values.to_numpy().view(np.uint64), owners.values.to_numpy()
            for k, at in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "salt", "role")), strict=True)):
                fp, ids = prints[starts[k] : starts[k + 1]], owners[starts[k] : starts[k + 1]]
                if at[2] == 0:
                    home, key = (fp.copy(), ids.copy()), at[:2]
                if key == at[:2]:
                    x, y = links(*home, fp, ids, at[2] == 0)
                    u.append(x)
                    v.append(y)
            if u and sum(map(len, u)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (fp, id) that differ in at most radius bits,
    reduced to a spanning set: no group is expanded into its pairs, none loses its connection.

    A tile is a set of up to TILE fingerprints with equal bit counts in each part; two tiles meet only if
    their bit counts differ by at most the radius in all. There are at most 17**4 kinds of tiles, so
    the table of kinds is small enough to broadcast whatever the corpus.
    """
    width = 64 // PARTS + 1
    cells = prints.withColumn("cell", _cell("fp"))
    kinds = cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("salts"))
    tiles = (
        cells.join(F.broadcast(kinds), "cell")
        .withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("salts")).cast("int"))
        .groupBy("cell", "salt").agg(F.collect_list(F.struct("fp", "id")).alias("x"))
        .select("cell", "salt", F.col("x.fp").alias("fps"), F.col("x.id").alias("ids"))
    )
    tiles = stored(tiles, "tiles")
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _steps(radius)]))
    part = lambda p: F.floor(F.col("cell") / width ** (PARTS - 1 - p)) % width
    moved = F.lit(0)
    inside = F.lit(True)
    for p in range(PARTS):
        at = part(p) + F.col("step")[p]
        inside &= at.between(0, width - 1)
        moved = moved * width + at
    guests = (
        tiles.withColumnsRenamed({"salt": "from"}).withColumn("step", step)
        .withColumns({"inside": inside, "to": moved.cast("int")}).where("inside and to <= cell")
        .join(F.broadcast(kinds.select(F.col("cell").alias("to"), "salts")), "to")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .where("to < cell or salt < from")
        .select(F.col("to").alias("cell"), "salt", F.lit(1).alias("role"), "fps", "ids")
    )
    meet = tiles.select("cell", "salt", F.lit(0).alias("role"), "fps", "ids").union(guests)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return meet.repartition(n, "cell", "salt").sortWithinPartitions("cell", "salt", "role").mapInArrow(_compare(radius), "a long, b long")


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) for the fingerprints of (doc_id, fp): the smallest doc_id reachable."""
    reps = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    reps = stored(reps, "fingerprints")
    roots = components(near_links(reps, radius), "simhash")
    return reps.join(roots, reps.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component"))


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long) and component of every row of docs (doc_id, text)."""
    prints = stored(with_fingerprint(docs.select("doc_id", "text"), out="fp").select("doc_id", "fp"), "simhash")
    groups = near_groups(prints, radius)
    return prints.join(groups, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without those that aren't the first of their component, by doc_id. Rows that repeat a
    doc_id stay or go together; rows without doc_id stay."""
    prints = stored(with_fingerprint(docs.select("doc_id", "text"), out="fp").select("doc_id", "fp"), "simhash")
    groups = near_groups(prints, radius)
    gone = prints.join(groups, "fp").where("doc_id <> component").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


class Shingles:
    """Distinct shingle hashes of texts, and their fingerprints of BITS bits."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, Hashes()
        self.factors = powers(0xD1342543DE82EF95, width + 1)
        self.steps = np.arange(1, BITS // 64 + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)

    def sets(self, texts: list[bytes]):
        """For each text its distinct shingle hashes, sorted: a text of fewer words is one shingle of them all, one of none has none."""
        page = normal(texts)
        found = list(self.words.of_page(page))
        h, where = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        stops = np.searchsorted(where, np.flatnonzero(page == END[0]), "right")
        del page, found, where
        joined = np.zeros(max(0, len(h) - self.width + 1), np.uint64)
        for k in range(self.width):
            joined += h[k : k + len(joined)] * self.factors[k + 1]
        joined ^= joined >> np.uint64(29)
        joined *= np.uint64(0xBF58476D1CE4E5B9)
        for first, stop in zip(np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True):
            if stop - first >= self.width:
                yield np.unique(joined[first : stop - self.width + 1])
            else:
                some = h[first:stop]
                yield np.sum(some * self.factors[: len(some)] + np.uint64(len(some)), keepdims=True)[: len(some)]

    def fingerprint(self, h: np.ndarray) -> np.ndarray:
        """BITS / 64 numbers: a bit is 1 if over half of the shingles' mixed hashes have it."""
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 255):  # so that counts of a block fit a byte
            x = h[at : at + 255] + self.steps
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            bits = np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1)
            counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
        return np.packbits(2 * counts > len(h)).view(np.uint64)


FP = [f"f{k}" for k in range(BITS // 64)]


def wide_prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, content (a hash of the set of shingles), size of the set, and f0, f1...: the bits of its fingerprint."""

    def run(batches):
        shingles = Shingles(width)
        for b in batches:
            at = 0
            for texts in groups(b.column(1)):
                content, size, prints = [], [], []
                for h in shingles.sets(texts):
                    content.append(xxhash.xxh64_intdigest(h, SEED))
                    size.append(len(h))
                    prints.append(shingles.fingerprint(h))
                prints = np.array(prints).view(np.int64)
                ids = b.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(size, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in prints.T)], names=["doc_id", "content", "size", *FP])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, content long, size long, " + ", ".join(f"{c} long" for c in FP))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, content and x, the set of shingles, of docs (doc_id, text)."""

    def run(batches):
        shingles = Shingles(width)
        for b in batches:
            at = 0
            for texts in groups(b.column(1)):
                sets = list(shingles.sets(texts))
                content = np.array([xxhash.xxh64_intdigest(h, SEED) for h in sets], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(content), lists], names=["doc_id", "content", "x"])
                at += len(texts)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, content long, x array<long>")


def _near(a, b, at: int, rows: int, begin: int, share: float):
    """Of two tiles (fingerprints, sizes, ...) the rows from `at` on of one and from begin on of the other that are candidates."""
    words = range(BITS // 64)
    apart = np.bitwise_count(a[0][0][at : at + rows, None] ^ b[0][0][None, begin:])
    apart += np.bitwise_count(a[0][1][at : at + rows, None] ^ b[0][1][None, begin:])
    x, y = np.nonzero(apart <= RADIUS_FIRST)
    x, y = x + at, y + begin
    whole = sum(np.bitwise_count(a[0][w][x] ^ b[0][w][y]).astype(np.int64) for w in words)
    least, most = np.minimum(a[1][x], b[1][y]), np.maximum(a[1][x], b[1][y])
    keep = (whole <= RADIUS_WIDE) & (least >= share * most - 1e-9)
    return x[keep], y[keep]


def _far(a, b) -> bool:
    """Whether the population counts of two tiles' fingerprints differ beyond the radius, word by word."""
    gap = 0
    for x, y in zip(a, b, strict=True):
        x, y = np.bitwise_count(x).astype(int), np.bitwise_count(y).astype(int)
        gap += max(0, x.min() - y.max(), y.min() - x.max())
    return gap > RADIUS_WIDE


def _tiles(batches, names: tuple[str, ...], links):
    """Hands each home tile (role 0) and then its guests to links(home, guest, same), and yields what that finds."""
    words, home, key = len(FP), None, None
    for b in batches:
        lists = [b.column(c) for c in (*FP, *names)]
        for k in range(b.num_rows):
            at = tuple(b.column(c)[k].as_py() for c in ("cell", "salt", "role"))
            columns = [c[k].values for c in lists]
            tile = [c.to_numpy().view(np.uint64) for c in columns[:words]], *(c.to_numpy() if c.type == pa.int64() else c for c in columns[words:])
            if at[2] == 0:
                home, key = tile, at[:2]
            if key == at[:2] and not _far(home[0], tile[0]):
                u, v = links(home, tile, at[2] == 0)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])


def _candidates(share: float):
    def links(a, b, same):
        """A spanning set of the candidates."""
        left, right, held = [], [], 0
        rows = max(1, (1 << 18) // max(1, len(b[1])))
        for at in range(0, len(a[1]), rows):
            x, y = _near(a, b, at, rows, at if same else 0, share)
            if same:
                x, y = x[x < y], y[x < y]
            left.append(a[2][x])
            right.append(b[2][y])
            held += len(x)
            if held > 4 * (len(a[1]) + len(b[1])):
                u, v = spanning(np.concatenate(left), np.concatenate(right))
                left, right, held = [u], [v], len(u)
        return spanning(np.concatenate(left), np.concatenate(right))

    return lambda batches: _tiles(batches, ("sizes", "contents"), links)


def _verified(share: float):
    def links(a, b, same):
        """Links of candidates that are alike, as far as they connect components that nothing has connected yet."""
        roots = np.unique(np.concatenate([a[3], b[3]]), return_inverse=True)[1]
        ra, rb = roots[: len(a[3])], roots[len(a[3]) :]
        ends, shingles = b[4].offsets.to_numpy().astype(np.int64), b[4].values.to_numpy().view(np.uint64)
        own_ends, own = a[4].offsets.to_numpy().astype(np.int64), a[4].values.to_numpy().view(np.uint64)
        u, v = [], []
        for i in range(len(a[1])):
            _, y = _near(a, b, i, 1, i + 1 if same else 0, share)
            y = y[rb[y] != ra[i]]
            if not len(y):
                continue
            mine = own[own_ends[i] : own_ends[i + 1]]
            sizes = b[1][y]
            stop = np.cumsum(sizes)
            every = shingles[np.repeat(ends[y] - stop + sizes, sizes) + np.arange(stop[-1])]
            at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
            common = np.add.reduceat((mine[at] == every).astype(np.int64), stop - sizes)
            for j in y[common >= share * (len(mine) + sizes - common) - 1e-9].tolist():
                if ra[i] != rb[j]:
                    old, new = rb[j], ra[i]
                    roots[roots == old] = new  # ra and rb are views
                    u.append(a[2][i])
                    v.append(b[2][j])
        return np.array(u, np.int64), np.array(v, np.int64)

    return lambda batches: _tiles(batches, ("sizes", "contents", "roots", "sets"), links)


def _met(tiles: DataFrame, guests: DataFrame, columns: list[str], compare) -> DataFrame:
    """Links (a, b) from tiles (cell, salt) and the guests of each."""
    meet = tiles.select("cell", "salt", F.lit(0).alias("role"), *columns).union(guests.select("cell", "salt", F.lit(1).alias("role"), *columns))
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return meet.repartition(n, "cell", "salt").sortWithinPartitions("cell", "salt", "role").mapInArrow(compare, "a long, b long")


def _collected(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Tiles of rows (cell, salt, ...): a list of each column."""
    lists = rows.groupBy("cell", "salt").agg(F.collect_list(F.struct(*columns.values())).alias("x"))
    return lists.select("cell", "salt", *(F.col(f"x.{c}").alias(name) for name, c in columns.items()))


def wide_links(prints: DataFrame, share: float = SHARE) -> DataFrame:
    """Pairs (a, b) of contents whose fingerprints differ in RADIUS_WIDE bits at most and whose sizes fit a similarity of
    share: of each pair of tiles a spanning set.

    A tile is a set of up to TILE_WIDE fingerprints of texts of a size class. Classes are a quarter of the factor 1 / share wide, so a
    tile meets those of its own class and of four below."""
    steps = 4
    cell = F.floor(F.round(F.log(F.col("size").cast("double")) * (steps / -np.log(share)), 6)).cast("int")
    cells = prints.withColumn("cell", cell)
    kinds = stored(cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE_WIDE).cast("int").alias("salts")), "kinds")
    columns = {c: c for c in FP} | {"sizes": "size", "contents": "content"}
    dealt = cells.join(F.broadcast(kinds), "cell")  # a class for each quarter of a step of size: some hundreds
    tiles = stored(_collected(dealt.withColumn("salt", F.pmod(F.xxhash64("content", F.lit(7)), F.col("salts")).cast("int")), columns), "tiles")
    guests = (
        tiles.withColumnsRenamed({"salt": "from", "cell": "own"}).withColumn("cell", F.explode(F.sequence(F.col("own") - steps, F.col("own"))))
        .join(F.broadcast(kinds), "cell")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .where("cell < own or salt < from")
    )
    return _met(tiles, guests, list(columns), _candidates(share))


def links_within(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """Links (a, b) between contents of rows (cell, content, size, root, x, fingerprint) of a cell that are alike and whose roots
    differ; of each pair of tiles those that connect. Candidates are compared where their tiles meet, so none but these is a row.

    A tile is a part of a cell, with up to TILE_SETS shingles or TILE_ROWS texts (one text at least)."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("size") / TILE_SETS)).cast("int").alias("salts"))
    columns = {c: c for c in FP} | {"sizes": "size", "contents": "content", "roots": "root", "sets": "x"}
    dealt = rows.join(sizes, "cell").withColumn("salt", F.pmod(F.xxhash64("content", F.lit(7)), F.col("salts")).cast("int"))
    tiles = stored(_collected(dealt, columns), "parts")
    met = tiles.join(sizes, "cell").withColumnRenamed("salt", "from").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where("salt < from")
    return _met(tiles, met, list(columns), _verified(share))


def sets_of(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """content and x, the set of shingles, of reps (content, id), from the texts of docs."""
    some = reps.select(F.col("id").alias("__id"), F.col("content").alias("__content"))
    texts = docs.join(some.select("__id").distinct(), docs["doc_id"] == F.col("__id"), "left_semi").select("doc_id", "text")
    sets = _sets(texts, width)
    return sets.join(some, (sets["doc_id"] == some["__id"]) & (sets["content"] == some["__content"]), "left_semi").dropDuplicates(["content"]).select("content", "x")


def alike(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, share: float) -> DataFrame:
    """Those of pairs (a, b) of reps' contents whose shingle sets share so much."""
    asked = pairs.select(F.col("a").alias("content")).union(pairs.select(F.col("b").alias("content"))).distinct()
    sets = stored(sets_of(docs, reps.join(asked, "content", "left_semi"), width), "sets")
    side = lambda c: sets.select(F.col("content").alias(c), F.col("x").alias(f"x{c}"))
    common = F.size(F.array_intersect("xa", "xb"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
    return both.where(F.col("common") >= share * (F.size("xa") + F.size("xb") - F.col("common")) - 1e-9).select("a", "b")


def _rooted(reps: DataFrame, roots: DataFrame, out: str) -> DataFrame:
    """reps with the least content that theirs is connected with."""
    return reps.join(roots.withColumnsRenamed({"node": "__node", "root": "__root"}), F.col("content") == F.col("__node"), "left").withColumn(out, F.coalesce("__root", "content")).drop("__node", "__root")


def keep_unlike(docs: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """The rows of docs without those that aren't the first, by doc_id, of their component of texts whose shingles
    have a Jaccard similarity of share or more.

    Candidates are texts whose fingerprints of BITS bits are near, by tiles, and every link is verified on the shingles: first
    a spanning set of each pair of tiles; then, where what candidates connect is not connected by verified links, all
    candidates across components, in tiles that bring their shingles along.

    Edge cases: rows that repeat a doc_id stay or go together; rows without doc_id stay; null, empty and blank texts are
    copies of one another; equal texts are one content, so ties go to the smallest doc_id; an empty table gives an empty
    result; all columns are kept, whatever their names."""
    prints = stored(wide_prints(docs.where("doc_id is not null").select("doc_id", "text"), width), "prints")
    reps = prints.groupBy("content").agg(F.min("doc_id").alias("id"), F.any_value("size").alias("size"), *(F.any_value(c).alias(c) for c in FP))
    reps = stored(reps, "contents")
    some = reps.where("size > 0")
    near = stored(wide_links(some, share).distinct(), "near")
    links = stored(alike(docs, near, reps, width, share), "links")
    roots = components(links, "sure")
    if links.count() < near.count():  # some candidates are not alike: others may connect what these did
        rooted = stored(_rooted(_rooted(some, roots, "root"), components(near, "near"), "cell"), "rooted")
        mixed = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
        mixed = stored(rooted.join(mixed, "cell", "left_semi"), "mixed")
        if not mixed.isEmpty():
            more = stored(links_within(mixed.join(sets_of(docs, mixed, width), "content"), share), "more")
            roots = components(links.union(more), "whole")
    ids = _rooted(reps.select("content", "id"), roots, "root")
    first = ids.groupBy("root").agg(F.min("id").alias("first"))
    first = ids.join(first, "root").select("content", "first")
    gone = prints.select("doc_id", "content").join(first, "content").where("doc_id <> first").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
