"""Classifier, languages, language model, fingerprints, shards and packing."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import fingerprints, language, lm_score, packing, quality, sharding
from sievemark.llm.common import words_of

from .conftest import corpus, prose


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# --- quality ---


def labelled(spark, n=240):
    rng = random.Random(8)
    texts = [prose(rng, 60) if i % 3 else "".join(f"{w}{rng.choice(('$$$', '%%%', '!!'))} " for w in prose(rng, 40).upper().split()) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int")


def test_quality_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    out = quality.with_score(docs, quality.train(docs, labels)).withColumn("held", quality.held_out()).collect()
    held = [r for r in out if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held]) > 0.95


def test_quality_gradients():
    rng = np.random.default_rng(0)
    net = quality.ByteNet()
    net.bias += np.float32(0.05)  # away from the kink that blocks of zeros stand on
    texts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (0, 5, 700, 1500)]
    y = np.array([1, 0, 1, 0], np.float32)
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := net.forward(texts)[0].astype(float), 1 - p)))
    grads = net.gradients(texts, y)
    for name, g in zip(("filters", "bias", "out"), grads, strict=False):
        w = getattr(net, name)
        for at in np.argsort(-abs(g).ravel())[:3]:
            keep, eps = w.flat[at], 1e-3
            w.flat[at] = keep + eps
            up = loss()
            w.flat[at] = keep - eps
            down = loss()
            w.flat[at] = keep
            assert (up - down) / (2 * eps) == pytest.approx(g.flat[at], rel=0.05, abs=2e-4)


def test_quality_reads_whole_texts():
    net = quality.ByteNet()
    a = b"plain words " * 4000
    assert net.forward([a])[0][0] != net.forward([a + b"$$$ %%% !!! ### @@@"])[0][0]
    assert net.forward([a, b"x"])[0][0] == pytest.approx(net.forward([a])[0][0], abs=1e-6)


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs, labels = labelled(spark, 60)
    net = quality.train(docs, labels.union(labels).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")))
    got = quality.with_score(odd, net, out="__s")
    assert got.count() == odd.count() and all(0 <= r["__s"] <= 1 for r in got.collect())
    assert {r["__s"] for r in quality.with_score(odd, quality.train(docs, none), out="__s").collect()} == {0.5}
    assert quality.with_score(empty, net).count() == 0


# --- language ---


def test_language_held_out(spark):
    rng = random.Random(3)
    data = [(i, prose(rng, rng.choice((3, 20, 200)), lang), lang) for i in range(300) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.train(docs)
    out = language.with_language(docs, model).withColumn("held", language.held_out()).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["lang_pred"] == r["lang"] for r in out if r["held"]]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    both = (prose(rng, 120, "en") + " " + prose(rng, 60, "de")).encode()
    lang, share = model.predict([both, prose(rng, 100, "de").encode(), b"the"])
    assert model.names[lang[0]] == "en" and 0.5 < share[0] < 0.8 and model.names[lang[1]] == "de" and share[1] > 0.95


def test_mixture_is_em():
    rng = np.random.default_rng(5)
    like = rng.uniform(0.01, 1, (2, 400))
    share, value = language.Languages.maximise(like, np.ones((2, 1), bool), np.array([400]), np.array([0]))
    best = max(np.log(p * like[0] + (1 - p) * like[1]).sum() for p in np.linspace(0.001, 0.999, 999))
    assert value[0] == pytest.approx(best, abs=0.05) and share.sum() == pytest.approx(1)


def test_language_odd(spark, odd, empty):
    model = language.train(odd)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?! ²"), (4, "漢字"), (5, "same text")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.with_language(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und" and got[5][0] in ("de", "en")
    assert language.with_language(empty, language.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language.with_language(df, language.train(empty)).collect()} == {"und"}


# --- language model ---


class SlowPPM:
    """Counts in dictionaries; follows the definition symbol by symbol."""

    def __init__(self, texts, order, least):
        self.order, grams = order, Counter()
        for t in texts:
            s = b"\n" * order + b" ".join(words_of(t)) + b"\n"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    grams[s[i - k : i + 1]] += 1
        self.total = sum(n for g, n in grams.items() if len(g) == 1)
        self.kept = {g: n for g, n in grams.items() if n >= (least if len(g) > 2 else 1)}

    def log10(self, context, symbol):
        out, refused = 0.0, set()
        for k in range(self.order, -1, -1):
            c = context[len(context) - k :] if k else b""
            own = {g[-1]: n for g, n in self.kept.items() if len(g) == k + 1 and g[:-1] == c}
            if not own:
                continue
            left = {s: n for s, n in own.items() if s not in refused}
            if not left:
                refused |= own.keys()
                continue
            seen = max(self.kept[c] if k else self.total, sum(own.values()))
            whole = seen - sum(own[s] for s in refused if s in own)
            if symbol in left:
                return out + math.log10((left[symbol] - lm_score.DISCOUNT) / whole)
            out += math.log10((seen - sum(own.values()) + lm_score.DISCOUNT * len(left)) / whole)
            refused |= own.keys()
        return out - math.log10(256 - len(refused))


def test_lm_against_definitions(spark, docs):
    data = corpus()
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in data}
    training = [(t or "").encode() for d, t in data if not held[d]]
    c = Counter(w for t in training for w in [*words_of(t), None])
    n, v = sum(c.values()), len(c)
    ppm = SlowPPM(training, 3, lm_score.LEAST)
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs, docs.where(~lm_score.held_out()), order=3).collect()}
    for d, t in data:
        w = [*words_of((t or "").encode()), None]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        if len(w) < 70:
            s = b"\n" * 3 + b" ".join(w[:-1]) + b"\n"
            assert r["score"] == pytest.approx(sum(ppm.log10(s[i - 3 : i], s[i]) for i in range(3, len(s))), rel=1e-9)


def test_lm_keeps_every_gram(spark, monkeypatch):
    """A gram that occurs twice counts however large the rest is, with many parts and chunks."""
    monkeypatch.setattr(lm_score, "GRAMS", 64, raising=False)
    monkeypatch.setattr(lm_score, "PART", 1 << 12, raising=False)
    rng = random.Random(8)
    rare = prose(rng, 30)
    data = [(d, prose(rng, 120)) for d in range(150)] + [(200, rare), (201, rare), (202, rare)]
    training = spark.createDataFrame(data, "doc_id long, text string")
    trie = lm_score.train(lm_score.count_all(training))[0]
    texts = {d: b" ".join(words_of(t.encode())) for d, t in data}
    grams = Counter(g for t in texts.values() for c in lm_score.codes([t])[0].tolist() for g in [c])
    assert sorted(trie.levels[-1]["code"].tolist()) == sorted(g for g, n in grams.items() if n >= lm_score.LEAST)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(training, training).collect()}
    assert got == {d: pytest.approx(trie.log10(lm_score.codes([t])[0]).sum(), rel=1e-9) for d, t in texts.items()}


def test_lm_is_a_distribution(docs):
    trie = lm_score.train(lm_score.count_all(docs))[0]
    for context in (b"\n\n\n\n\n\n", b"d the ", b"zzzzzz"):
        codes = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.uint64)
        assert (10 ** trie.log10(codes)).sum() == pytest.approx(1)


def test_lm_odd(spark, odd, empty):
    got = lm_score.score_documents(odd, odd.where(~lm_score.held_out())).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    r = lm_score.score_documents(odd, empty).where("doc_id = 2").first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(-math.log10(256))
    assert lm_score.score_documents(empty, empty).count() == 0


# --- fingerprints ---


def shingles(t):
    w = words_of((t or "").encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("part", [16 << 20, 2000])
def test_fingerprints(docs, monkeypatch, part):
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (part,))
    data = sorted(corpus(), key=lambda x: x[0])
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(got) == len(data)
    errors = []
    for i, (d, t) in enumerate(data):
        t, after = t or "", data[(i + 1) % len(data)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(t), shingles(other)
            errors.append(abs(r[near] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(errors) < 0.2 and np.mean(errors) < 0.03
    prints = {}
    for d, t in data:
        prints.setdefault(t or "", set()).add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and set(got[1]["fingerprint"]) == {"0"}


def test_densified_bins_are_unbiased():
    f, rng = fingerprints.Fingerprints(), random.Random(1)
    for size, common in ((6, 3), (40, 20), (400, 100)):
        got = []
        for _ in range(60):
            shared = [f"s{rng.random()} a b c d" for _ in range(common)]
            a, b = ("\n".join([*shared, *(f"u{rng.random()} a b c d" for _ in range(size - common))]) for _ in range(2))
            got.append(f.likeness(f.values(a.encode()), f.values(b.encode())) - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
        assert abs(np.mean(got)) < 0.03


def test_fingerprints_odd(odd, empty):
    got = fingerprints.fingerprint_edits(odd)
    assert got.count() == odd.count() and all(0 <= r["near_edited"] <= 1 for r in got.collect())
    assert fingerprints.fingerprint_edits(empty).count() == 0


# --- shards ---


def test_shards(spark):
    rng = random.Random(2)
    data = [(i, prose(rng, rng.randint(1, 60))) for i in range(3000)]
    data += [(5000 + i, "one text that many rows share " * 3) for i in range(150)] + [(9000, None), (9001, "")]
    got = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    text = dict(data)
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    assert all((r["size"], r["text_crc32"]) == (len((text[r["doc_id"]] or "").encode()) + 1, zlib.crc32((text[r["doc_id"]] or "").encode())) for r in got)
    total, slots, homes = Counter(), {}, {}
    for r in got:
        total[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(text[r["doc_id"]] or "", set()).add(r["shard"])
    assert sorted(total) == list(range(16)) and max(total.values()) < 1.03 * min(total.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in homes.values())


def test_shards_split_on_language_and_source(spark):
    """The widest dimension is cut first, languages far apart in the alphabet, then sources; copies go with the least of theirs."""
    rng = random.Random(4)
    names = [(lang, source) for lang in ("aa", "zz") for source in ("bb", "yy")]
    rows = [(4 * i + k, f"{i:04d}{k} " + prose(rng, 3)[:11].ljust(11, "x"), lang, source) for i in range(800) for k, (lang, source) in enumerate(names)]
    rows += [(10_000 + i, "a text of several languages", *names[i % 4]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(k) for k, c in enumerate(("size", "group", "tie", "node", "shard", "at_lang", "low_lang"))})
    where = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 4).collect()}
    halves = Counter((lang, where[d] // 2) for d, _, lang, _ in rows if d < 10_000)
    assert halves["aa", 0] + halves["zz", 1] >= 0.97 * sum(halves.values())  # a cut may miss the half by a little
    one = [(source, where[d]) for d, _, lang, source in rows if d < 10_000 and lang == "aa" and where[d] < 2]
    assert sum(shard == (source == "yy") for source, shard in one) >= 0.97 * len(one)  # where one language is left, sources are widest
    assert len({where[10_000 + i] for i in range(12)}) == 1


def test_group_that_no_shard_holds_is_cut(spark):
    rng = random.Random(2)
    data = [(i, "the same text again and again") for i in range(1000)] + [(2000 + i, prose(rng, 20)) for i in range(300)]
    total = Counter()
    for r in sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string")).collect():
        total[r["shard"]] += r["size"]
    assert len(total) == 16 and max(total.values()) < 1.1 * min(total.values())


def test_runs_of_slots(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 5)
    got = sharding.with_slots(docs.select("doc_id", (F.col("doc_id") % 2).alias("shard")), "doc_id").collect()
    for s in (0, 1):
        x = sorted(r["slot"] for r in got if r["shard"] == s)
        assert x == list(range(len(x)))


def test_shards_odd(odd, empty):
    got = sharding.shard_documents(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["shard"] < 16 for r in got)
    assert sharding.shard_documents(empty).count() == 0


# --- packing ---


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    whole, own = Tokenizer.from_file(path), packing.WordTokens(path)
    rng, alphabet = random.Random(1), "aZé  \n\t.,'sdtm!_1²٣…\x01\x1c\xa0İßΣςé<|>endoftextÀ中É\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a<|endoftext|>b <|ENDOFTEXT|>", "it's WE'LL 'S", ""] + [t or "" for _, t in corpus()]
    got = [x for i in range(0, len(texts), 200) for x in own.encode([t.encode() for t in texts[i : i + 200]])]
    assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack_documents(docs, packing.vocabulary_path(), length=256).collect()
    pieces, seqs = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert len(pieces) == docs.count()
    for d, t in corpus():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256


@pytest.mark.parametrize(("segments", "loss"), [(256, 2048), (2, 2048), (8, 300)])
def test_all_limits_hold(segments, loss):
    rng = np.random.default_rng(4)
    items = [(i, np.arange(n, dtype=np.uint32), int(n * s)) for i, (n, s) in enumerate(zip(rng.integers(1, 5000, 400), rng.uniform(0, 1, 400), strict=True))]
    total, many, bearing, seen = Counter(), Counter(), Counter(), Counter()
    for key, start, ids, size, seq, offset in packing.pack_rows(iter(items), 2048, segments, loss, 0):
        assert offset == total[seq] and size == len(items[key][1]) and ids[0] == start
        total[seq] += len(ids)
        many[seq] += 1
        bearing[seq] += len(ids) * items[key][2] / size
        seen[key] += len(ids)
    assert all(seen[k] == len(ids) for k, ids, _ in items)
    assert max(total.values()) <= 2048 and max(many.values()) <= segments and max(bearing.values()) <= loss + segments + 1
    if segments == 256 and loss == 2048:
        assert sum(total.values()) > 0.99 * 2048 * len(total)


def test_packing_odd(odd, empty):
    got = packing.pack_documents(odd, packing.vocabulary_path()).collect()
    assert len(got) == odd.count() and [r["doc_tokens"] for r in got if r["doc_id"] == 2] == [1]
    assert packing.pack_documents(empty, packing.vocabulary_path()).count() == 0
