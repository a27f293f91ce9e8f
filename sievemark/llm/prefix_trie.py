"""Prefix trie of conversations by leaf peeling.

1. Turns are put in order by a range sort over all conversations, so that a long one is spread over tasks, and numbered.
2. A node is a distinct sequence of first turns. It is known by a SHA-256 over the SHA-256s of its turns, taken in blocks of FAN turns
   and blocks of blocks, so that no task needs a whole conversation. Turns move as digests, never as texts.
3. Nodes in line that have the same members form a chain; the first and last members of nested sets tell (same smallest one, same
   number), so no rounds are needed for that. Each chain becomes one node of the trie that is peeled.
4. Peeling: each chain has a counter of children that have not finished. Those at 0 have finished: they leave, with their totals, which
   are combined by parent and sent there; parents lower their counters. The rounds end when the root has finished; there are as many as
   there are chains on the longest way down.

Nothing meets in one task but what has a bound: FAN turns of a block, RUN ids of a node's ends (a longer list of ids is hashed as a
stream). Keys that many rows have (the root's children, a long chain) are looked up in a broadcast table of HOT rows at most.

Edge cases: null role or text is empty text; turns are ordered by turn, nulls first, and those with the same turn by the SHA-256
of role and text; repeated rows are turns of their own; rows with a null conv_id belong to no conversation and are left out;
without conversations there are no nodes; columns other than conv_id, turn, role, text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, looked_up, stored, table

FAN, RUN_BITS = 32, 12
#: Rounds after which what has finished is written as one table.
KEEP = 16
#: Fixed values of the spliced conversations: ids of a group, most turns that are taken over.
GROUP, HEADS = 100, 6
ROOT = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, n code points of the text), stored."""
    text, role = (F.coalesce(c, F.lit("")) for c in ("text", "role"))
    digest = _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("n"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = ["conv_id", "turn", "digest", "row"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            start = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            pos = np.arange(1, len(conv) + 1) - np.repeat(start, np.diff(np.append(start, len(conv))))
            if conv[0] == last:
                pos[: start[1] if len(start) > 1 else len(conv)] += seen
            last, seen = conv[-1], pos[-1]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(pos), batch.column("digest"), batch.column("n")], names=["conv_id", "part", "pos", "digest", "n"])

    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = stored(sorted_.mapInArrow(numbered, "conv_id long, part int, pos long, digest string, n long"), "numbered")
    discard(rows)
    # only the first and last conversation of a task lie in others, too
    pieces = own.groupBy("conv_id", "part").agg(F.max("pos").alias("size")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "size"))).alias("pieces"))
    pieces = pieces.where(F.size("pieces") > 1).select("conv_id", "pieces", F.posexplode("pieces").alias("k", "piece"))
    before = F.aggregate(F.slice("pieces", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x["size"])
    out = own.join(F.broadcast(pieces.select("conv_id", "piece.part", before.alias("before"))), ["conv_id", "part"], "left")
    return stored(out.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "n"), "ordered")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, length)."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("length"))


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin with the first turns of their group's first id: as many as their id's CRC says."""
    heads = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % HEADS
    own = lengths(turns)
    base = own.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": heads("conv_id")}).join(base, "base", "left")
    convs = stored(convs.withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0)))), "convs")
    first = turns.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    first = first.join(convs.select("base", "conv_id", "taken"), "base").where("pos <= taken").select("conv_id", "pos", "digest", "n")
    rest = looked_up(turns.where(F.col("pos") > heads("conv_id")), convs.select("conv_id", "taken", "h", "length"), "conv_id", "length", turns.count())
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n")
    return stored(first.unionByName(rest), "spliced"), convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("length") - F.col("h"))).alias("length"))


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, key, parent_key, n, total): the key of each conversation's first depth turns, of all but the last of them, and the
    code points of all of them."""
    blocks = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / FAN).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n"))).alias("s"))
    of = lambda size: F.array_join(F.transform(F.slice("s", 1, size), lambda x: x["digest"]), "")
    n_of = lambda size: F.aggregate(F.slice("s", 1, size), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    if longest >= FAN:  # full blocks are the turns of a shorter conversation
        blocks = stored(blocks, "blocks")
        whole = blocks.where(F.size("s") == FAN).select("conv_id", (F.col("block") + 1).alias("pos"), _digest(of(F.lit(FAN))).alias("digest"), n_of(F.lit(FAN)).alias("n"))
        above = prefixes(whole, longest // FAN)
        ends = above.select("conv_id", (F.col("depth") - 1).alias("block"), F.col("key").alias("last"), F.lit(None).alias("first"), F.lit(None).alias("before"))
        starts = above.select("conv_id", F.col("depth").alias("block"), F.lit(None).alias("last"), F.col("key").alias("first"), F.col("total").alias("before"))
        both = ends.unionByName(starts).groupBy("conv_id", "block").agg(*(F.max(c).alias(c) for c in ("last", "first", "before")))
        blocks = blocks.join(both, ["conv_id", "block"], "left")
    else:
        blocks = blocks.withColumns({"last": F.lit(None).cast("string"), "first": F.lit(None).cast("string"), "before": F.lit(None).cast("long")})
    blocks = blocks.withColumns({"first": F.coalesce("first", F.lit(ROOT)), "before": F.coalesce("before", F.lit(0).cast("long"))})
    key = lambda i: F.when(i == FAN - 1, F.col("last")).otherwise(_digest(F.col("first"), of(i + 1)))
    keyed = F.transform("s", lambda x, i: F.struct(x["pos"].alias("depth"), key(i).alias("key"), x["n"].alias("n"), (F.col("before") + n_of(i + 1)).alias("total")))
    each = blocks.select("conv_id", "first", keyed.alias("s")).select("conv_id", "first", "s", F.posexplode("s").alias("i", "x"))
    parent = F.when(F.col("i") == 0, F.col("first")).otherwise(F.get("s", F.col("i") - 1)["key"])
    return each.select("conv_id", "x.depth", "x.key", parent.alias("parent_key"), "x.n", "x.total")


def peeled(chains: DataFrame) -> DataFrame:
    """(key, n_leaves, saved) over each subtree of a forest of (key, parent, n_children, own), own being a node's part of saved."""
    state = chains.select("key", "parent", F.col("n_children").alias("remaining"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("own").alias("saved"))
    state = stored(state, "peel")
    done: list[DataFrame] = []
    while not (done and state.isEmpty()):
        ready = state.where("remaining = 0").select("key", "parent", "n_leaves", "saved")
        done.append(ready.drop("parent"))
        sent = ready.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("finished"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sum_ = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        left = state.where("remaining > 0").join(sent, "key", "left").select("key", "parent", (F.col("remaining") - F.coalesce("finished", F.lit(0))).alias("remaining"), sum_("n_leaves", "more_leaves"), sum_("saved", "more_saved"))
        state = stored(left, "peel")
        if len(done) == KEEP:
            done = [stored(_union(done), "peeled")]
    return _union(done)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the SHA-256 of each key's ids in order, with commas."""
    runs = ends.groupBy("key", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out: list[tuple[str, str]] = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == last:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        out.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
            if out:
                yield batch_of(out)
        if state:
            yield batch_of([(last, state.hexdigest())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["key", "ends_sha256"])

    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(hashed, "key string, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the conversations in lengths (conv_id, length) with their turns (conv_id, pos, digest, n): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and key, the SHA-256 that nodes are known by."""
    about = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("length").alias("longest")).first()
    ways = stored(prefixes(turns, about["longest"] or 0), "prefixes")
    nodes = ways.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("parent_key", "n", "total")))
    spark, no = turns.sparkSession, F.lit(None).cast("string")
    root = spark.range(1 if about["n"] else 0).select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(about["least"]).cast("long").alias("conv_id"), F.lit(about["n"]).cast("long").alias("n_convs"), no.alias("parent_key"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
    nodes = stored(nodes.unionByName(root), "nodes")

    chain = ["conv_id", "n_convs"]
    chains = nodes.groupBy(*chain).agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.max_by("key", "depth").alias("key"), F.min_by("parent_key", "depth").alias("parent"),
        F.min(F.col("total") - F.col("n")).alias("before"), F.max("total").alias("total"), F.count("*").alias("size"),
    )
    chains = stored(chains, "chains")
    children = chains.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    chains = stored(chains.join(children, "key", "left").fillna(0, ["n_children"]), "counted")
    sums = peeled(chains.withColumn("own", (F.col("n_convs") - 1) * (F.col("total") - F.col("before"))))

    ends = ways.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key")).select("key", "conv_id")
    ends = ends.unionByName(lengths.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    whole = chains.join(sums, "key").join(ends_digest(ends), "key", "left")
    above = chains.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("above"), "n_children")
    n_chains = chains.count()
    whole = looked_up(stored(whole.drop("total").withColumnRenamed("n_children", "below"), "whole"), above, "parent", "n_children", n_chains)
    whole = stored(whole.select(*chain, "top", "bottom", "before", "size", "below", "n_leaves", "saved", "ends_sha256", "above"), "chains_done")

    out = looked_up(nodes, whole, chain, "size", nodes.count())
    last = F.col("depth") == F.col("bottom")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("below")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("total") - F.col("n") - F.col("before"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(ROOT))).otherwise(F.lit(ROOT)).alias("ends_sha256"), "key",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*spliced(ordered_turns(table(spark, sf_dir, "conversations")))).drop("key")


#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
ORACLE = f"""
WITH t AS (SELECT conv_id, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, g, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS own, p.pos, g, n FROM c JOIN p ON p.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 1, p.pos, g, n FROM c JOIN p ON p.conv_id = c.conv_id AND pos > h),
w AS (SELECT conv_id, row_number() OVER v AS depth, sha256(string_agg(g, '') OVER v) AS k, n FROM s WINDOW v AS (PARTITION BY conv_id ORDER BY own, pos)),
r AS (SELECT conv_id, depth, k, n, depth = max(depth) OVER (PARTITION BY conv_id) AS stops FROM (SELECT * FROM w UNION ALL SELECT conv_id, 0, '', 0 FROM c)),
node AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM r GROUP BY ALL),
way AS (SELECT r.conv_id AS member, r.depth, node.conv_id FROM r JOIN node USING (depth, k)),
up AS (SELECT node.*, way.conv_id AS parent_conv_id FROM node LEFT JOIN way ON way.member = node.conv_id AND way.depth = node.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (conv_id, depth)),
sums AS (SELECT way.conv_id, way.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens FROM whole JOIN way ON way.member = whole.conv_id AND way.depth <= whole.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM whole JOIN sums USING (conv_id, depth)
"""
