"""Prefix trie, exact-dedup index and filter audit against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import common, exact_dedup, filter_audit, prefix_trie

from .conftest import CLASH, corpus

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_convs(rows):
    """Turns (role, text) of each conversation in order."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}


def plain_splice(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = set()
    for k, ms in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(convs[c]) == len(k)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.add((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), children[k], sum(not children[x] for x in below), saved, sha(ends)))
    return out


def talks(seed=3, n=90):
    """Conversations with shared beginnings, copies, ties of turns, nulls and a long one; of ids from three groups and below 0."""
    rng = random.Random(seed)
    said = ["hello", "what is it", "", None, "漢字 text", "no", "a longer answer to that"]
    rows, held = [], []
    for c in rng.sample(range(-120, 420), n) + [200, 300]:
        if held and rng.random() < 0.4:
            turns = list(rng.choice(held)[: rng.randrange(1, 9)])
        else:
            turns = [(rng.choice(["user", "bot", None]), rng.choice(said)) for _ in range(rng.randrange(1, 8))]
        held.append(turns)
        rows += [(c, i if rng.random() < 0.95 else rng.choice([None, 1]), *t) for i, t in enumerate(turns)]
    rows += [(250, i, "user", f"turn {i % 7}") for i in range(150)] + [(251, i, "user", f"turn {i % 7}") for i in range(150)] + [(252, i, "user", f"turn {i % 7}") for i in range(64)]
    rows += [(None, 0, "user", "lost"), (260, 0, "user", "same"), (260, 0, "user", "same")]
    rng.shuffle(rows)
    return rows


def nodes(df):
    return {(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("fan, hot, run_bits", [(32, 1000, 12), (4, 3, 2), (5, 1, 0)])
def test_trie(spark, monkeypatch, fan, hot, run_bits):
    """Whatever the size of blocks, of hot keys and of runs of ids."""
    for module, name, value in ((prefix_trie, "FAN", fan), (common, "HOT", hot), (prefix_trie, "RUN_BITS", run_bits), (prefix_trie, "KEEP", 3)):
        monkeypatch.setattr(module, name, value)
    rows = talks()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    convs = plain_convs(rows)
    turns = prefix_trie.ordered_turns(df)
    assert {(r["conv_id"], r["pos"]): r["n"] for r in turns.collect()} == {(c, i + 1): len(t[1]) for c, ts in convs.items() for i, t in enumerate(ts)}
    got = prefix_trie.trie(turns, prefix_trie.lengths(turns))
    assert got.count() == len(nodes(got)) and nodes(got) == plain_trie(convs)
    assert nodes(prefix_trie.trie(*prefix_trie.spliced(turns))) == plain_trie(plain_splice(convs))


def test_trie_of_few(spark):
    """Nothing, one turn, a conversation that loses all its turns, and columns with clashing names."""
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(*prefix_trie.spliced(prefix_trie.ordered_turns(none))).count() == 0
    bare = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    rows = [(bare, 0, "user", "gone")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("z") for c in [*CLASH, "pos", "digest", "part", "block", "s"]})
    turns = prefix_trie.ordered_turns(df)
    assert nodes(prefix_trie.trie(turns, prefix_trie.lengths(turns))) == plain_trie({bare: [("user", "gone")]})
    assert nodes(prefix_trie.trie(*prefix_trie.spliced(turns))) == {(bare, 0, None, 1, 0, 1, 0, sha(str(bare)))}


def keys(names):
    return np.array([hashlib.sha256(str(x).encode()).digest() for x in names], "S32")


def test_cuckoo_filter():
    f = exact_dedup.CuckooFilter.for_keys(1000)
    assert f.insert(keys(range(1000))) and f.contains(keys(range(1000))).all()
    assert f.contains(keys(range(1000, 6000))).mean() < 0.01
    f.delete(keys(range(0, 1000, 2)))
    assert f.contains(keys(range(1, 1000, 2))).all() and f.contains(keys(range(0, 1000, 2))).mean() < 0.02
    assert f.insert(keys(range(0, 1000, 2))) and f.contains(keys(range(1000))).all()
    assert (f.slots != 0).sum() == 1000
    small = exact_dedup.CuckooFilter(np.zeros((4, exact_dedup.SLOTS), np.uint16))
    assert not small.insert(keys(range(40)))


def entries(pairs):
    out = np.zeros(len(pairs), exact_dedup.ENTRY)
    out["digest"], out["id"], out["row"], out["n"] = keys([x for x, _ in pairs]), [i for _, i in pairs], range(len(pairs)), 1
    return out


def test_shard_against_a_dictionary(monkeypatch):
    """Insertions and deletions in any order; filters that fill up are built anew; fingerprints that all collide."""
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(exact_dedup.CuckooFilter, "parts", staticmethod(lambda d: (np.ascontiguousarray(d).view("<u8").reshape(-1, 4)[:, 0].astype(np.int64) & 0x7FFFFFFF, np.full(len(d), 7, np.uint16))))
        rng = random.Random(5)
        shard, live = exact_dedup.Shard(entries([])), {}
        buckets = {len(shard.filter.slots)}
        for turn in range(30):
            some = [(rng.randrange(300), rng.randrange(1000)) for _ in range(rng.randrange(60))]
            if turn % 3 == 2:
                shard.delete(entries(some))
                for x, i in set(some):
                    if x in live and live[x][0] == i:
                        del live[x]
            else:
                shard.insert(exact_dedup.combined(entries(some)))
                for x, i in some:
                    live[x] = (max(live[x][0], i), live[x][1] + 1) if x in live else (i, 1)
            buckets.add(len(shard.filter.slots))
            assert (shard.filter.slots != 0).sum() == len(live)
            want = {k: v for k, v in zip(keys(live), live.values(), strict=True)}
            assert {d: (i, n) for d, i, n in zip(shard.content["digest"], shard.content["id"], shard.content["n"], strict=True)} == want
        assert len(buckets) > 1


def plain_groups(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text), as a multiset."""
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = Counter()
    for t, ids in by.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        out.update((i, ids[-1], len(ids), k == len(ids) - 1, sha(t)) for k, i in enumerate(ids))
    return out


@pytest.mark.parametrize("hot, chunk", [(1000, 1 << 16), (3, 5)])
def test_exact_groups(spark, docs, odd, empty, monkeypatch, hot, chunk):
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(exact_dedup, "CHUNK", chunk)
    for df in (docs.repartition(5), odd, empty):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = exact_dedup.exact_groups(exact_dedup.digests(df)).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got) == plain_groups(rows)
        kept = exact_dedup.without_copies(df)
        assert kept.columns == df.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for (i, _, _, k, _), n in plain_groups(rows).items() for _ in range(n) if k)


def test_index_over_batches(spark):
    """Batches in any order give what one gives; a text whose live row is deleted may come in again, a replaced row changes nothing."""
    rows = [(i, f"text {i % 40}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    part = lambda k: exact_dedup.digests(df.where(F.col("doc_id") % 3 == k))
    live = lambda index: {r["digest"].hex(): (r["keep_id"], r["group_size"]) for r in index.keys.collect()}
    index = exact_dedup.new_index(spark, 120)
    for k in (2, 0, 1):
        index = exact_dedup.insert(index, part(k))
    assert live(index) == {sha(f"text {k}"): (80 + k, 3) for k in range(40)} == live(exact_dedup.insert(exact_dedup.new_index(spark, 120), exact_dedup.digests(df)))
    index = exact_dedup.delete(index, exact_dedup.digests(df.where("doc_id < 50 or doc_id >= 110")))
    assert live(index) == {sha(f"text {k}"): (80 + k, 3) for k in range(30)}
    index = exact_dedup.insert(index, exact_dedup.digests(df.where("doc_id in (35, 36, 0)")))
    assert live(index)[sha("text 35")] == (35, 1) and live(index)[sha("text 0")] == (80, 4) and len(live(index)) == 32


def plain_audit(rows, labels):
    """rows: (doc_id, source, text)."""
    fails, parts = [], defaultdict(list)
    for i, source, text in rows:
        text = text or ""
        words = [w for w in text.translate({c: " " for c in (32, *range(9, 14))}).split(" ") if w]
        earlier = any((t or "") == text and i is not None and (j is None or j < i) for j, _, t in rows)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": earlier}
        fails.append(f)
        mine = [x for x in labels if x[0] == i and i is not None]
        parts[source or ""].append((f, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    out = {}
    for part, docs in parts.items():
        taken = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[0][x]]
                stay = [d for d in left if not d[0][x]]
                redundant = sum(d[0][x] for d in docs) - len(gone)
                out[part, order, step] = [len(stay), len(gone), redundant, sum(d[0][x] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                taken[x] += len(gone)
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(taken[order[step - 1]])
    return out


def test_filter_audit(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    rng = random.Random(8)
    rows = [(i, rng.choice(["web", "code", None]), (t or "") + rng.choice(["", " #", " SHOUTED WORDS HERE", "\x0b  a|b"]) if t is not None else None) for i, t in corpus(40)]
    rows += [(500, "web", "Ab\x1cc " * 60), (501, None, "x y z " * 30), (502, "code", rows[0][2]), (None, "code", rows[0][2]), (502, "web", rows[0][2]), (503, "empty", "")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in rows if rng.random() < 0.7] + [(rows[0][0], 1, 1), (rows[0][0], 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("z") for c in [*CLASH, "mask", "digest", "part"]})
    marked = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = filter_audit.audit(filter_audit.cells(filter_audit.masks(df, F.col("source")), marked)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == 600 * 4 and {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == plain_audit(rows, labels)
    none = filter_audit.audit(filter_audit.cells(filter_audit.masks(empty, F.col("lang")), marked))
    assert none.count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(filter_audit.cells(filter_audit.masks(df, F.col("source")), marked), "ABCDEFG")


def test_audit_of_other_filters(spark):
    """Two filters of another caller."""
    cells = spark.createDataFrame([("p", m, 0, 0, n) for m, n in ((0, 5), (1, 3), (2, 2), (3, 4))], "part string, mask int, good int, toxic int, n long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.audit(cells, "AB").collect()}
    assert got == {("AB", 1): (7, 7, 0, 3, 10), ("AB", 2): (5, 2, 4, 2, 8), ("BA", 1): (8, 6, 0, 2, 8), ("BA", 2): (5, 3, 4, 3, 10)}
