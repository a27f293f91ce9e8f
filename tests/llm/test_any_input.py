"""Texts of any bytes and any length, columns of any names, and workers that cannot import the package."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import decontam, fingerprints, language, license_scan, lm_score, packing, quality, sharding, simhash, streams, suffix_dedup
from sievemark.llm.common import words_of

from .conftest import corpus, prose

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def broken(spark):
    """Texts that are no UTF-8, beside good ones."""
    good = spark.createDataFrame([(i, t) for i, t in corpus(20)], "doc_id long, text string")
    bad = spark.createDataFrame([(500, bytearray(b"good words \xff\xfe then \xc3 more words here " * 4)), (501, bytearray(b"\x80"))], "doc_id long, text binary")
    return good.unionByName(bad.withColumn("text", F.col("text").cast("string")))


def test_broken_utf8(spark, broken, empty):
    net = quality.ByteNet().fit([b"good words", b"bad words"] * 8, np.array([1, 0] * 8, np.float32), 1)
    model = language.Languages(["en"]).fit([[b"good words here"]])
    n = broken.count()
    bench = spark.createDataFrame([(1, "some other item of six words")], "item_id long, text string")
    for df in (
        quality.with_score(broken, net), language.with_language(broken, model), fingerprints.fingerprint_edits(broken), simhash.simhash_components(broken),
        suffix_dedup.cleaned(broken), decontam.clean(broken, bench), sharding.shard_documents(broken, 4), lm_score.score_documents(broken, F.lit(True)),
    ):
        assert len(df.select("doc_id").toArrow()) == n
    assert {500, 501} <= {r["doc_id"] for r in simhash.keep_unlike(broken).select("doc_id").collect()}
    assert license_scan.scan(broken).count() == 0
    got = {r["doc_id"]: r["n_chars"] for r in fingerprints.fingerprint_edits(broken).collect()}
    assert got[501] == 1
    pieces = packing.pack_documents(broken, packing.vocabulary_path()).where("doc_id = 501").collect()
    assert [r["length"] for r in pieces] == [r["doc_tokens"] for r in pieces]


@pytest.fixture(scope="module")
def long_text():
    import random

    rng = random.Random(12)
    some = [prose(rng, 400) for _ in range(8)]
    return " ".join(rng.choice(some) for _ in range(1500)).encode()[: (5 << 20) // 2] + b"  \t" + b"x" * (3 << 19) + b" end "


def test_normal_form(long_text):
    for texts in ([long_text], [t.encode() if t else b"" for _, t in corpus(30)], [b" \t ", b"", b"a", b" A  b\n"]):
        page = streams.normal(texts)
        assert page.tobytes() == b"".join(b" ".join(words_of(t)) + b"\n" for t in texts)
        h = streams.Hashes()
        found = [x for part in h.of_page(page) for x in part[0].tolist()]
        every = [w for t in texts for w in words_of(t)]
        one = {w: next(iter(streams.Hashes().of_page(streams.normal([w]))))[0][0] if len(w) <= streams.PAGE else None for w in set(every)}
        assert len(found) == len(every) and len(set(found)) == len(set(every))
        assert all(one[w] is None or one[w] == x for w, x in zip(every, found, strict=True))
        code = np.concatenate(list(lm_score.page_codes(page)))
        assert (code == lm_score.codes([b" ".join(words_of(t)) for t in texts])[0]).all()
    assert b"".join(streams.spans(long_text)) == long_text and max(map(len, streams.spans(long_text))) < 3 << 20


def test_long_texts(long_text):
    """What is worked out in parts is what the whole text gives."""
    net = quality.ByteNet().fit([b"good words", b"bad words"] * 8, np.array([1, 0] * 8, np.float32), 1)
    assert net.scores([long_text, b"ab"]) == pytest.approx(net.forward([long_text, b"ab"])[0], abs=2e-6)
    model = language.Languages(["de", "en"]).fit([[b"der die und ist zu mit"], [b"the of and to in"]])
    some = long_text[:200_000]
    lang, share = model.predict([some])
    model.at_once = 10_000
    assert model.predict([some])[0] == lang and model.predict([some])[1] == pytest.approx(share)
    words = words_of(long_text)
    h = np.array([streams_hash(words[i : i + 4]) for i in range(len(words) - 3)], np.uint64)
    bits = [int(2 * (h >> np.uint64(b) & np.uint64(1)).sum() > len(h)) for b in range(64)]
    assert simhash.simhash(long_text) == sum(x << b for b, x in enumerate(bits))
    tokens = packing.WordTokens(packing.vocabulary_path())
    short = long_text[:1_300_000]
    whole = packing.WordTokens(packing.vocabulary_path()).whole.tokenizer.encode(short.decode(), add_special_tokens=False).ids
    assert tokens.encode([short])[0].tolist() == whole


def streams_hash(words):
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join(words), 42)


def test_more_languages_than_full(monkeypatch):
    monkeypatch.setattr(language, "FULL", 2)
    names = [f"l{i}" for i in range(5)]
    texts = [" ".join(chr(97 + 5 * i + j) * 3 for j in range(5)).encode() for i in range(5)]
    model = language.Languages(names).fit([[t] * 3 for t in texts])
    assert model.log.nbytes <= 2 << 20 and [names[i] for i in model.predict(texts)[0]] == names


def test_clashing_names(spark, docs):
    df = docs.select("*", *(F.lit("kept").alias(c) for c in ("score", "lang_pred", "simhash", "text_bytes")))
    model = language.Languages(["en"]).fit([[b"good words here"]])
    for out in (quality.with_score(df, quality.ByteNet()), language.with_language(df, model), simhash.with_fingerprint(df)):
        assert len(set(out.columns)) == len(out.columns) and out.select(*df.columns).distinct().count() == df.distinct().count()


def test_wrapped_and_embedded_notices(spark):
    gpl = textwrap.wrap(license_scan.TEMPLATES["gpl-header"], 72)
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n".join(textwrap.wrap(license_scan.MIT, 76)) + "\n"
    texts = {
        1: "\n".join("# " + x for x in gpl) + "\nimport os\n" + "".join(f"x{i} = y{i} + z{i}\n" for i in range(60)),
        2: "This file, which others wrote, is released under the MIT License and may be used by all who read it. " + "More words follow. " * 20,
        3: mit,
        4: "/*\n" + "\n".join(" * " + x for x in mit.split("\n")) + "\n */\n" + "".join(f"int f{i}(void) {{ return g{i}(h{i}); }}\n" for i in range(200)),
        5: "No notice is here, only a licence to print the words of others in the United States. " * 5,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["template"], r["line"]) for r in license_scan.scan(df).collect()}
    assert {(1, "gpl-header", license_scan.WINDOW), (2, "mit", license_scan.WINDOW), (3, "mit-text", license_scan.WHOLE), (4, "mit-text", license_scan.WINDOW)} <= got
    assert not [x for x in got if x[0] == 5]


def test_from_another_folder(tmp_path):
    """Executors whose Python can't import the package run the queries with models."""
    code = f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        import __spark_entry__ as entry
        sys.path.remove({str(ROOT)!r})
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
        for name in ("op3_quality", "op4_language", "op5_lm_score"):
            print(name, len(entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    """
    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("no test tables")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and said.stdout.count("op") == 3, said.stderr[-3000:]
