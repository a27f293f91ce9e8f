"""Sharding by a K-d tree: a node is split at the weighted median of its widest dimension until the leaves
have the target bytes.

Dimensions are metadata: language and source as places in the alphabet, the text's bytes on a logarithmic scale, bytes a code point
(script) and share of blanks (length of words). Where copies of a text differ in language or source, the least counts for all
of them; ties are broken by a hash of the text. So equal texts stand together and share a shard. Groups of equal texts that would unbalance a cut (HEAVY of a leaf or more, so at most
1/HEAVY times the leaves) are placed first, each whole into the leaf with most room; medians are then weighted by
the room left below. Only a group that no leaf can hold is cut, by a hash of doc_id. Medians are found by rounds of
weighted histograms over a shrinking range, for all nodes of a level at once: a round sends the driver at most BINS
numbers a node, never rows. Levels cost scans of a narrow table, no shuffle of rows.

Edge cases: a null text has 0 bytes and size 1, null dimensions count as the least; rows that repeat are placed once
each (fully equal ones side by side); fewer rows than shards leave shards empty; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, total

SHARDS = 16
#: Bits of a dimension's value and of the hash behind it, and bins of a histogram.
VALUE, HASH, BINS = 22, 40, 4096
#: How far from the median a cut may be, as a share of a leaf.
SLACK = 0.002
#: Share of a leaf from which a group of equal texts is placed by itself.
HEAVY = 0.05
#: Rows in one run of slots.
RUN = 50_000


def _of_node(values: list, kind: str) -> Column:
    """The node's entry of a list; nodes are numbered from 0."""
    return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("node"))


def _cuts(points: DataFrame, nodes: dict[int, dict], dims: list[str], leaf: float) -> dict[int, tuple[int, int, int]]:
    """(dimension, key, tie) of each node: rows left of the cut have a smaller (key, tie)."""
    open_ = {}
    for node, x in nodes.items():
        order = sorted(range(len(dims)), key=lambda d: (x["low"][d] - x["high"][d], d))
        open_[node] = {"order": order, "at": 0, "low": x["low"][order[0]], "high": x["high"][order[0]] + 1, "tie": False, "half": x["share"] * x["bytes"], "before": 0, "best": None}
    done: dict[int, tuple[int, int, int]] = {}
    while open_:
        rows = [(node, s["order"][s["at"]], s["low"], max(1, -(-(s["high"] - s["low"]) // BINS)), s["high"], s["key"] if s["tie"] else None) for node, s in open_.items()]
        by, ids = {r[0]: r for r in rows}, range(max(open_) + 1)
        ask = {name: _of_node([by[i][j] if i in by else None for i in ids], kind) for j, (name, kind) in enumerate((("dim", "int"), ("low", "long"), ("step", "long"), ("high", "long"), ("key", "long")), 1)}
        p = points.withColumns(ask).where("dim is not null")
        value = F.get(F.array(*dims), F.col("dim"))
        at = F.when(F.col("key").isNull(), value).when(value == F.col("key"), F.col("tie"))
        p = p.withColumn("at", at).where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
        bins = p.groupBy("node", F.floor((F.col("at") - F.col("low")) / F.col("step")).cast("int").alias("bin")).agg(F.sum("size").alias("n")).collect()
        found: dict[int, list] = {}
        for r in bins:
            found.setdefault(r["node"], []).append((r["bin"], r["n"]))
        for node, _, low, step, _, _ in rows:
            s = open_[node]
            seen, slack = s["before"], SLACK * leaf
            for b, n in sorted(found.get(node, [])):
                if seen + n >= s["half"]:
                    break
                seen += n
            left, right = abs(seen - s["half"]), abs(seen + n - s["half"])
            edge, miss, go = (low + b * step, left, seen) if left <= right else (low + (b + 1) * step, right, seen + n)
            cut = (s["order"][s["at"]], s["key"], edge) if s["tie"] else (s["order"][s["at"]], edge, 0)
            if miss <= slack or s["tie"] and step == 1:
                done[node] = cut
            elif step > 1:
                s["low"], s["high"], s["before"] = low + b * step, low + (b + 1) * step, seen
            else:  # a group of equal texts stands on the median
                if s["best"] is None or miss < s["best"][0]:
                    s["best"] = (miss, cut)
                s.setdefault("groups", []).append((low + b, seen))
                if s["at"] + 1 < len(s["order"]):
                    s["at"] += 1
                    d = s["order"][s["at"]]
                    s["low"], s["high"], s["before"] = nodes[node]["low"][d], nodes[node]["high"][d] + 1, 0
                elif s["best"][0] <= HEAVY * leaf:
                    done[node] = s["best"][1]
                else:  # too large: cut it along the widest dimension
                    s["at"], s["tie"] = 0, True
                    s["key"], s["before"] = s["groups"][0]
                    s["low"], s["high"] = 0, 1 << HASH
        open_ = {n: s for n, s in open_.items() if n not in done}
    return done


def kd_shards(points: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """points (size, group, tie, dims as longs) with shard: 0 to shards - 1, of nearly equal size each."""
    leaf = max(1.0, total(points, F.col("size")) / shards)
    groups = points.groupBy("group").agg(F.sum("size").alias("n")).where(F.col("n").between(HEAVY * leaf, leaf))
    room = [leaf] * shards
    home = []
    for r in sorted(groups.collect(), key=lambda r: (-r["n"], r["group"])):  # at most shards / HEAVY rows
        at = max(range(shards), key=lambda i: (room[i], -i))
        if room[at] >= r["n"]:
            room[at] -= r["n"]
            home.append((r["group"], at))
    placed = None
    if home:
        homes = points.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({g}L, {i})" for g, i in home) + " AS t(group, shard)")
        placed = points.join(F.broadcast(homes), "group").select(*points.columns, "shard")
        points = points.join(F.broadcast(homes), "group", "left_anti")
    wanted = {0: (0, shards)}  # node: first shard, number of shards
    rest = points.columns
    points = points.withColumn("node", F.lit(0))
    while any(n > 1 for _, n in wanted.values()):
        bounds = [F.min(d).alias(f"low{i}") for i, d in enumerate(dims)] + [F.max(d).alias(f"high{i}") for i, d in enumerate(dims)]
        have = {r["node"]: r for r in points.groupBy("node").agg(F.sum("size").alias("bytes"), *bounds).collect()}  # one row a node
        nodes = {
            k: {"bytes": have[k]["bytes"], "share": sum(room[first : first + n // 2]) / max(1e-9, sum(room[first : first + n])), "low": [have[k][f"low{i}"] for i in range(len(dims))], "high": [have[k][f"high{i}"] for i in range(len(dims))]}
            for k, (first, n) in wanted.items() if n > 1 and k in have
        }
        cuts = _cuts(points, nodes, dims, leaf)
        rows, after = [], {}
        for k, (first, n) in sorted(wanted.items()):
            if n == 1 or k not in have:
                rows.append((k, 0, 1 << 62, 0, len(after), len(after)))
                after[len(after)] = (first, 1)
            else:
                rows.append((k, *cuts[k], len(after), len(after) + 1))
                after[len(after)] = (first, n // 2)
                after[len(after)] = (first + n // 2, n - n // 2)
        way = {name: _of_node([r[j] for r in rows], kind) for j, (name, kind) in enumerate((("dim", "int"), ("key", "long"), ("cut", "long"), ("left", "int"), ("right", "int")), 1)}
        value = F.get(F.array(*dims), F.col("dim"))
        before = (value < F.col("key")) | ((value == F.col("key")) & (F.col("tie") < F.col("cut")))
        side = F.when(before, F.col("left")).otherwise(F.col("right"))
        # as a generator's row, so that filters on the node aren't moved below it and copied level by level
        points = points.withColumns(way).select(*rest, F.explode_outer(F.array(side)).alias("node"))
        wanted = after
    points = points.withColumn("shard", _of_node([wanted[k][0] for k in sorted(wanted)], "int")).drop("node")
    return points.unionByName(placed) if placed is not None else points


def shards_for(total: int, target: int) -> int:
    """Leaves that have about the target bytes."""
    return max(1, round(total / target))


def with_slots(placed: DataFrame, *order: str) -> DataFrame:
    """placed with slot, gapless from 0 in each shard: runs of rows by hash are counted, then numbered each."""
    rows = placed.groupBy("shard").count().agg(F.max("count").alias("n")).first()["n"] or 0
    runs = max(1, rows // RUN)
    dealt = placed.withColumn("run", F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int"))
    sizes = dealt.groupBy("shard", "run").count()
    first = sizes.withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.row_number().over(Window.partitionBy("shard", "run").orderBy(*order)) - 1
    out = dealt.withColumn("slot", number).join(first.select("shard", "run", "first"), ["shard", "run"])
    return out.withColumn("slot", (F.col("slot") + F.coalesce("first", F.lit(0))).cast("long")).drop("run", "first")


def _place(name: str) -> Column:
    """Where a name stands in the alphabet, from 0 to 1, by its first four characters."""
    letter = lambda i: F.greatest(F.lit(0), F.least(F.lit(27), F.ascii(F.substring(F.lower(F.coalesce(name, F.lit(""))), i, 1)) - 96))
    return sum((letter(i) / 28.0**i for i in range(2, 5)), letter(1) / 28.0)


def shard_documents(docs: DataFrame, shards: int = SHARDS, target: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of all documents, in so many shards, or in as many as have about target bytes each. docs
    may have lang and source, which are dimensions then."""
    text = F.coalesce("text", F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    scaled = lambda x: F.least(F.greatest(F.floor(x * (1 << VALUE)), F.lit(0)), F.lit((1 << VALUE) - 1)).cast("long")
    spread = F.shiftrightunsigned(F.xxhash64(text, F.lit(11)), 64 - HASH)
    key = lambda x: F.shiftleft(F.coalesce(scaled(x), F.lit(0).cast("long")), HASH) + spread
    size = (F.octet_length(text) + 1).cast("long")
    blanks = chars - F.length(F.replace(text, F.lit(" "), F.lit("")))
    named = [c for c in ("lang", "source") if c in docs.columns]
    points = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.lit(13)).alias("group"), F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(12)), 64 - HASH).alias("tie"),
        key(F.log2(size) / 40).alias("length"), key((F.octet_length(text) / chars - 1) / 3).alias("script"), key(blanks / chars).alias("blanks"),
        *(key(_place(c)).alias(f"at_{c}") for c in named),
    )
    points = stored(points, "points")
    shards = shards_for(total(points, F.col("size")), target) if target else shards
    if named:
        low, high = ([f(f"at_{c}").alias(f"{n}_{c}") for c in named] for n, f in (("low", F.min), ("high", F.max)))
        torn = " or ".join(f"low_{c} < high_{c}" for c in named)
        least = points.groupBy("group").agg(*low, *high).where(torn).select("group", *(f"low_{c}" for c in named))
        points = points.join(least, "group", "left").withColumns({f"at_{c}": F.coalesce(f"low_{c}", f"at_{c}") for c in named}).drop(*(f"low_{c}" for c in named))
        points = stored(points, "groups")
    dims = [*(f"at_{c}" for c in named), "length", "script", "blanks"]
    placed = stored(kd_shards(points, dims, shards).select("doc_id", "size", "text_crc32", "tie", "shard"), "shards")
    return with_slots(placed, "tie", "doc_id", "text_crc32").drop("tie")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
