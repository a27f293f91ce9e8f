"""SimHash, suffix windows, decontamination and licences against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievemark.llm import decontam, license_scan, simhash, suffix_dedup
from sievemark.llm.common import components, words_of

from .conftest import corpus, prose


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def slow_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, docs):
    data = corpus()
    fp = {d: slow_simhash(t) for d, t in data}
    want = slow_components([(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4], fp)
    got = simhash.simhash_components(docs).collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == fp
    assert {r["doc_id"]: r["component"] for r in got} == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(want.values())


def test_simhash_chains_and_groups(spark):
    """A chain of fingerprints four bits apart, and a large group of near fingerprints, some in other tiles."""
    rng = np.random.default_rng(2)
    chain = [0]
    for i in range(15):
        chain.append(chain[-1] ^ (0b1111 << (4 * i)))
    group = [(1 << 63) ^ sum(1 << int(b) for b in rng.choice(30, 2, replace=False)) for _ in range(300)]
    far = [int(x) for x in rng.integers(0, 2**63, 500)]
    prints = list(dict.fromkeys([*chain, *group, *far]))
    a = np.array(prints, np.uint64)
    links = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 4)]
    want = slow_components([(j, i) for i, j in links], range(len(a)))
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(a.view(np.int64))], "doc_id long, fp long")
    got = {r["fp"]: r["component"] for r in simhash.near_groups(df).collect()}
    assert [got[int(x)] for x in a.view(np.int64)] == [want[i] for i in range(len(a))]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(x), int(y)) for x, y in rng.integers(0, 200, (130, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = slow_components(edges, {x for e in edges for x in e})
    assert all(got.get(n, n) == r for n, r in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd(odd, empty):
    got = rows(simhash.simhash_components(odd), "doc_id", "component")
    assert got == sorted([(None, None), (5, 5), (5, 5), (5, 2), (2, 2), (9, 9)], key=str)
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


def slow_windows(data, size=50):
    seen, out = set(), {}
    for d, text in sorted(data):
        t = (text or "").encode()
        gone = bytearray(len(t))
        mine = {t[i : i + size] for i in range(len(t) - size + 1)}
        for i in range(len(t) - size + 1):
            if t[i : i + size] in seen:
                gone[i : i + size] = b"\1" * size
        seen |= mine
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[d] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("bucket", "wide"), [(4 << 20, 2000), (3000, 2000), (3000, 1)])
def test_suffix_windows(spark, docs, monkeypatch, bucket, wide):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    data = [*corpus(), (2000, "a" * 400), (2001, "b" + "a" * 300), (2002, "xyz" * 60), (2003, "xyz" * 30 + "!")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["__sd_bytes"], r["__sd_removed"], r["__sd_spans"], hashlib.sha256(r["__sd_kept"]).hexdigest()) for r in suffix_dedup.dedup_windows(df).collect()}
    assert got == slow_windows(data)


def test_suffix_other_window(spark):
    data = [(i, t) for i, (_, t) in enumerate(corpus(30))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["__sd_removed"] for r in suffix_dedup.dedup_windows(df, window=20).collect()}
    assert got == {d: x[1] for d, x in slow_windows(data, 20).items()}


def test_anchors_in_pieces(monkeypatch):
    text = np.frombuffer(("ab" * 40 + "".join(t or "" for _, t in corpus(20))).encode(), np.uint8)
    whole = suffix_dedup.make_kernels().anchors(text)
    monkeypatch.setattr(suffix_dedup, "PIECE", 777)
    parts = suffix_dedup.make_kernels().anchors(text)
    owner = lambda found: np.repeat(found[0], found[2] - found[1] + 1)
    assert (owner(whole) == owner(parts)).all() and len(owner(whole)) == len(text) - 49


def test_suffix_odd(spark, odd, empty):
    line = "a line of more than fifty bytes that stands in several rows, é"
    df = spark.createDataFrame([(None, line), (1, line), (1, line), (2, line + "x")], "doc_id long, text string")
    assert rows(suffix_dedup.cleaned(df), "doc_id", "text") == sorted([(None, line), (1, ""), (1, ""), (2, "x")], key=str)
    same = spark.createDataFrame([(1, line), (1, line)], "doc_id long, text string")
    assert rows(suffix_dedup.cleaned(same), "text") == [(line,), (line,)]
    assert suffix_dedup.cleaned(odd).columns == odd.columns and suffix_dedup.cleaned(odd).count() == odd.count()
    assert suffix_dedup.cleaned(empty).count() == 0
    taken = same.withColumns({c: F.lit(1) for c in ("__sd_text", "__sd_kept", "__sd_bucket")})
    assert suffix_dedup.cleaned(taken).columns == taken.columns and suffix_dedup.cleaned(taken).count() == 2


def test_whole_chars(spark):
    tail = "é" * 30
    df = spark.createDataFrame([(1, "x" + tail), (2, "ß" + tail[:-1] + "è")], "doc_id long, text string")
    got = dict(rows(suffix_dedup.cleaned(df), "doc_id", "text"))
    assert got[1] == "x" + tail and set(got[2]) <= set("ßéè") and len(got[2]) < 31


def test_radix_groups():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, (400, 50)).astype(np.uint8)
    data[:, :40] = 7
    label = suffix_dedup.make_kernels().radix_groups(data)
    keys = [bytes(x) for x in data]
    for i in range(400):
        same = [j for j in range(400) if keys[j] == keys[i]]
        assert (label[i] == -1) == (len(same) == 1) and {int(label[j]) for j in same} == {int(label[i])}


def grams(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return w, {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment(spark):
    import random

    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((12, 30, 30, 5, 3, 60))] + [(50, None), (51, "")]
    data = [(i, prose(rng, 80)) for i in range(20)] + [(30, prose(rng, 40) + " " + items[1][1].upper() + "! " + prose(rng, 3000)), (31, None), (32, "")]
    half = items[2][1].split()
    data += [(40, " ".join([*half[:26], *prose(rng, 4).split()])), (41, " ".join(half[:20])), (42, prose(rng, 9) + " " + items[3][1]), (43, items[4][1]), (44, "x " + items[4][1] + " y"), (45, " ".join([*half[:15], "changed", *half[16:]]))]
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontam.matches(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in items:
        w, q = grams(t)
        width = min(5, len(w))
        q = q or ({" ".join(w)} if w else set())
        for d, x in data:
            v = [y for y in re.split(r"[\W_]+", (x or "").lower()) if y]
            has = {" ".join(v[k : k + width]) for k in range(len(v) - width + 1)} if width else set()
            if q and len(q & has) / len(q) >= 0.8 - 1e-9:
                want[d, i] = len(q & has) / len(q)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items()) and {(30, 1), (44, 4), (40, 2)} <= got.keys()


def test_containment_without_broadcast(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, corpus()[4][1])], "item_id long, text string")
    want = rows(decontam.matches(docs, items), "doc_id", "item_id", "containment")
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert want and rows(decontam.matches(docs, items), "doc_id", "item_id", "containment") == want


def test_containment_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "same text here for all"), (1, "same text here for all"), (None, "other words stand in this one")], "item_id long, text string")
    assert rows(decontam.clean(odd, items), "doc_id") == [(2,), (5,)]
    assert decontam.clean(odd, items).columns == odd.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(odd, none).count() == odd.count() and decontam.matches(odd, none).count() == 0
    assert decontam.matches(empty, items).count() == 0


def test_licences(spark, odd, empty):
    text = "Some prose.\nReleased under the MIT License.\nmore\nreleased UNDER the 'mit' license"
    df = spark.createDataFrame([(1, text), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "word"), (5, text), (5, text)], "doc_id long, text string")
    got = rows(license_scan.scan(df), "doc_id", "line", "template")
    assert [x for x in got if x[0] == 1] == [(1, 1, "mit"), (1, 3, "mit")] and len([x for x in got if x[0] == 5]) == 4
    assert (2, 0, "cc-by-nc-4.0") in got and (2, 0, "cc-by-4.0") not in got
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0


def test_licences_against_all_pairs(spark, docs):
    extra = [(2000, license_scan.TEMPLATES["gpl-3.0"] + "\n" + "the of " * 5), (2001, "x\n" + license_scan.TEMPLATES["mit-grant"] + " and more words here")]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = []
    for d, t in [*corpus(), *extra]:
        lines = (t or "").split("\n")
        for i, unit in [*enumerate(lines), *([(-1, t)] if len(lines) > 1 else [])]:
            a = set(license_scan.template_bigrams(unit))
            for k, b in license_scan.TEMPLATES.items():
                b = set(license_scan.template_bigrams(b))
                if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                    want.append((d, i, k))
    assert rows(license_scan.scan(df), "doc_id", "line", "template") == sorted(want, key=str) and want


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_licences_are_told_by_words(spark, threshold):
    """Texts without the words are left out, and no choice of as many bigrams as a match takes is without any of them."""
    known = license_scan.TEMPLATES | {"short": "a b c", "odd": "x Ünder x"}
    words = license_scan.telling_words(known, threshold / (2 - threshold))
    for t in known.values():
        b = license_scan.template_bigrams(t)
        free = [x for x in b if not any(w in x for w in words)]
        assert len(free) < max(1, threshold / (2 - threshold) * len(b))
    df = spark.createDataFrame([(1, "X\nA b! c"), (2, "x ÜNDER  x"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    assert set(rows(license_scan.scan(df, known, threshold), "doc_id", "template")) == {(1, "short"), (2, "odd")}


def test_words():
    assert words_of("A\tb\x0bC\x1cd É ".encode()) == [b"a", b"b", b"c\x1cd", "É".encode()] and words_of(None) == []


def alike_numbers():
    """Two texts of 72 bytes that share bytes 8 to 63 and that multiply-and-add over words of 8 bytes takes for one."""
    odd, top = 0x9E3779B97F4A7C15, 1 << 64
    rng = np.random.default_rng(4)
    shared = bytes(rng.integers(97, 123, 56).astype(np.uint8))
    word = lambda b: int.from_bytes(b, "little")

    def after(first):
        h = 0
        for w in (first, *(shared[i : i + 8] for i in range(0, 56, 8))):
            h = ((h ^ (h >> 29)) * odd + word(w)) % top
        return (h ^ (h >> 29)) * odd % top

    one, last = b"abcdefgh", b"ijklmnop"
    for _ in range(200_000):
        two = bytes(rng.integers(32, 127, 8).astype(np.uint8))
        end = ((after(one) + word(last) - after(two)) % top).to_bytes(8, "little")
        if two != one and all(32 <= c < 127 for c in end):
            return one + shared + last, two + shared + end
    raise AssertionError("none found")


@pytest.mark.parametrize("sort_key", [None, "same", "few"])
def test_suffix_whatever_the_numbers(spark, monkeypatch, sort_key):
    """Surroundings are told apart by what they are, whatever the numbers by which they are put in order."""
    key = {None: None, "same": lambda rec: np.zeros(len(rec), np.uint64), "few": lambda rec: rec["x"][:, 0].astype(np.uint64) % 3}[sort_key]
    rng = np.random.default_rng(6)
    letters = lambda n: bytes(rng.integers(97, 101, n).astype(np.uint8))
    shared = [letters(56), letters(70), letters(140)]
    texts = [(k, b) for k, b in enumerate(alike_numbers())]
    for d in range(2, 60):
        texts.append((d, letters(int(rng.integers(0, 30))) + shared[d % 3][int(rng.integers(0, 5)) :] + letters(int(rng.integers(0, 30))) + shared[(d + 1) % 3]))
    df = spark.createDataFrame([(d, t.decode()) for d, t in texts], "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "BUCKET", 600)  # many buckets
    got = {r["doc_id"]: r["__sd_removed"] for r in suffix_dedup.dedup_windows(df, sort_key=key).collect()}
    assert got == {d: x[1] for d, x in slow_windows([(d, t.decode()) for d, t in texts]).items()} and got[1] == 56


def test_suffix_rows_of_one_id(spark):
    """Rows that share a doc_id keep their own texts, and what goes from each is its own."""
    text = prose(random.Random(3), 40)
    rows_ = [(7, text), (7, "x " + text + " y"), (7, text), (9, text + " tail of another kind"), (9, "a longer head " + text)]
    got = rows(suffix_dedup.dedup_windows(spark.createDataFrame(rows_, "doc_id long, text string").repartition(1)).withColumn("kept", F.col("__sd_kept").cast("string")), "doc_id", "kept")
    # the second text of 9 has a blank before the shared words that no text of 7 has, but "x " + text + " y" does
    assert got == sorted([(7, text), (7, "x " + text + " y"), (7, text), (9, "tail of another kind"), (9, "a longer head")], key=str)


def test_licence_windows_by_places(spark):
    """The best window of every template, against all windows; among words of the licences themselves, too."""
    rng = random.Random(2)
    known = {k: license_scan.TEMPLATES[k] for k in ("apache-2.0", "mit-grant", "cc-by-4.0", "isc", "bsd-conditions")}
    texts = []
    for k in range(40):
        notice = list(known.values())[k % 5].split()
        for _ in range(k % 4):
            notice[rng.randrange(len(notice))] = rng.choice(["other", "license", "copy"])
        texts.append(" ".join([*prose(rng, rng.randrange(20)).split(), *notice, *prose(rng, rng.randrange(20)).split()]) + "\nnext line")
    texts.append(" ".join(rng.choice(" ".join(known.values()).split()) for _ in range(400)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["template"]): (r["word"], round(r["dice"], 9)) for r in license_scan.scan(df, known).where(f"line = {license_scan.WINDOW}").collect()}
    units = {(r["doc_id"], r["template"]) for r in license_scan.scan(df, known).where(f"line <> {license_scan.WINDOW}").collect()}
    want = {}
    for d, t in enumerate(texts):
        g = license_scan.text_bigrams(t)
        for name, template in known.items():
            b, size = set(license_scan.text_bigrams(template)), len(license_scan.text_bigrams(template))
            best = max(((2 * len(w & b) / (len(w) + len(b)), -i) for i in range(len(g)) if g[i] in b for w in [set(g[i : i + size])]), default=(0, 0))
            if best[0] >= license_scan.THRESHOLD and (d, name) not in units:
                want[d, name] = (-best[1], round(best[0], 9))
    assert got == want and len(want) > 10
