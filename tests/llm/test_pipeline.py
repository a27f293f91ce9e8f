"""The pipeline's stages on a small corpus, and the registry."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sievemark.llm import registry, simhash

from .conftest import CLASH, prose

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(6)
    folder = tmp_path_factory.mktemp("tables")
    bench = [(i, prose(rng, 30)) for i in range(4)]
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 150)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1]), (102, prose(rng, 50) + " " + passage + " " + prose(rng, 50)), (103, prose(rng, 50) + " " + passage), (104, prose(rng, 90) + " " + bench[2][1] + " " + prose(rng, 90))]
    rows += [(200 + i, "".join(f"{w}{rng.choice(('$$$', '%%%', '!!'))} " for w in prose(rng, 120).upper().split())) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(d, int(d < 200), 0) for d, _ in rows if d % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), passage


def test_stages(spark, tables):
    folder, passage = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, unique, cut, clean = seen
    assert not [d for d in good if d >= 200] and {d for d in range(60)} <= good.keys()
    assert {100, 101} & unique.keys() == set() and {3, 4, 102, 103, 104} <= unique.keys()
    assert passage in cut[102] and passage not in cut[103] and cut.keys() == unique.keys()
    assert cut.keys() - clean.keys() == {104}
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == clean.keys()
    whole = lambda df: {(r["doc_id"], r["doc_tokens"]) for r in df.collect()}
    assert whole(corpus_pipeline.run(spark, folder)) == whole(packed)


def test_near_copies_go(spark, tmp_path):
    """Copies with a similarity of 0.8 to 0.95 go, and texts that are less alike stay."""
    rng = random.Random(9)

    def changed(text, n):
        w = text.split()
        for k in range(n):
            w[(2 * k + 1) * len(w) // (2 * n)] = f"new{k}"
        return " ".join(w)

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def similar(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b)

    base = [prose(rng, 200) for _ in range(24)]
    copies = {100 + i: changed(t, 1 + i % 4) for i, t in enumerate(base)}
    assert all(0.8 <= similar(t, copies[100 + i]) <= 0.96 for i, t in enumerate(base))
    other = {200 + i: changed(t, 10) for i, t in enumerate(base)}
    assert all(similar(t, x[k]) < 0.8 for i, t in enumerate(base) for x, k in ((other, 200 + i),))
    assert all(similar(copies[100 + i], other[200 + i]) < 0.8 for i in range(24))
    rows = [*enumerate(base), *copies.items(), *other.items()]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(24), *other}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_keeps_what_brute_force_keeps(spark, seed):
    """Texts at all distances from one another, short ones and chains among them: the same rows stay as by all pairs."""
    rng = random.Random(seed)

    def shingles(text):
        w = text.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    base = [prose(rng, n).split() for n in (5, 7, 12, 30, 60, 60, 120, 300)]
    rows = []
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            w[rng.randrange(len(w))] = rng.choice(("one", "other", "third"))
        rows.append((1000 - 3 * k if k % 2 else 3 * k, " ".join(w) if k % 17 else rng.choice(("", None, " \t", "Two words"))))
    sets = {t or "": shingles(t or "") for _, t in rows}
    texts = sorted(sets)
    alike = lambda a, b: a == b or (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if alike(a, b):
                root[find(a)] = find(b)
    first: dict = {}
    for d, t in rows:
        group = find(t or "")
        first[group] = min(d, first.get(group, d))
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").withColumn("content", F.lit("a column of the caller")).repartition(5)
    got = simhash.keep_unlike(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(d for d, _ in rows if d in first.values())


def test_whole_pipeline_on_odd_columns(spark, tables, tmp_path):
    """Columns with clashing names, rows of null, repeated rows: run() as a whole."""
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, "some words of a text without a number", "en", None, None), (7000, None, None, None, 0), (7001, "", None, "src", 0), (7001, "", None, "src", 0)], docs.schema)
    docs.unionByName(odd).withColumns({c: F.lit("z") for c in CLASH}).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    plain = {(r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, folder).collect()}
    got = {(r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {x for x in got if x[0] is not None and x[0] < 7000} == plain


def test_near_copies_odd(spark, odd, empty):
    got = simhash.keep_unlike(odd)
    assert got.columns == odd.columns and simhash.keep_unlike(empty).count() == 0
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 2), (False, 9), (True, 0)]


def test_registry():
    assert [sum(k.startswith(f"op{n}_") for k in registry.queries()) for n in range(1, 14)] == [1] * 13
    assert set(registry.oracle_sql()) <= set(registry.queries()) and "pipeline" in entry.queries()


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = c.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, str(DATA))
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(x) for x in cols]
    assert sorted(map(str, (tuple(r[x] for x in cols) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))
