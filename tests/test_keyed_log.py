"""Keyed tables, replacement by partition, repair of torn logs and manifests of files."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievemark.sources import keyed_log, records


def files(folder):
    return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(folder).rglob("*.parquet"))}


def table(spark, *kv):
    return spark.createDataFrame(list(kv), "key string, p_yes double")


def stored(spark, path):
    return {r["key"]: r["p_yes"] for r in keyed_log.read_table(spark, path).collect()}


def test_appends_read_what_they_touch(spark, tmp_path):
    """One row in a hundred more: below a twentieth of the table's files and rows are read, and none is written over."""
    path = str(tmp_path / "t")
    keyed_log.append(spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("double").alias("p_yes")), path, 0, 128)
    before = files(path)
    assert stored(spark, path) == {f"k{i}": float(i) for i in range(300)}
    batch = table(spark, ("k7", 0.5), ("new", 0.25), ("k7", 0.5))
    read = spark.read.parquet(path).where(F.col("bucket").isin(keyed_log.touched(batch, 128)))
    assert len(read.inputFiles()) == len(before)  # planned for all; pruned when it runs
    scanned = {r["f"] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(scanned) < 0.05 * len(before) and read.count() < 0.05 * 300
    assert "PartitionFilters: [bucket" in read._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "")
    added = keyed_log.append(batch, path, 1, 128)
    assert [(r["key"], r["p_yes"]) for r in added.collect()] == [("new", 0.25)]
    assert stored(spark, path) == {f"k{i}": float(i) for i in range(300)} | {"new": 0.25}
    assert before.items() <= files(path).items()


def test_a_batch_may_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        keyed_log.append(table(spark, ("a", 0.1), ("b", 0.2)), path, 3, 4)
    assert stored(spark, path) == {"a": 0.1, "b": 0.2} and keyed_log.read_table(spark, path).count() == 2
    keyed_log.append(table(spark), path, 4, 4)
    with pytest.raises(Exception):
        keyed_log.append(table(spark, ("c", 0.1), ("c", 0.2)), path, 5, 4)
    assert stored(spark, path) == {"a": 0.1, "b": 0.2}


def test_empty_first_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed_log.append(table(spark), path, 0, 4)
    keyed_log.append(table(spark, ("a", 0.1)), path, 1, 4)
    assert stored(spark, path) == {"a": 0.1}


def test_only_given_partitions_change(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(c, i) for c in ("one", "two", "a/b c", "last") for i in range(3)], "config string, v int")
    rows.write.partitionBy("config").parquet(path)
    before = files(path)
    keyed_log.replace_partitions(spark.createDataFrame([("two", 9), ("new", 8)], "config string, v int"), path, "config", ["last", "two"])
    after = files(path)
    untouched = {k: v for k, v in before.items() if not k.startswith(("config=two", "config=last"))}
    assert untouched.items() <= after.items() and len(after) == len(untouched) + 2
    got = sorted((r["config"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == sorted([("one", i) for i in range(3)] + [("a/b c", i) for i in range(3)] + [("two", 9), ("new", 8)])


def test_torn_ends_are_kept_aside(spark, tmp_path):
    line = lambda k: json.dumps({"key": k, "answer": "é {", "p_yes": 0.5, "config": "c"})
    folder, aside = tmp_path / "log", tmp_path / "aside"
    folder.mkdir()
    texts = {"torn": f'{line("a")}\n{line("b")}\n{{"key": "c", "answer": "{{é', "whole": f"{line('d')}\n", "open": f"{line('e')}\n{line('f')}", "only": '{"key'}
    for name, text in texts.items():
        (folder / f"{name}.jsonl").write_text(text)
    assert {(Path(r["source"]).name, r["keep"]) for r in keyed_log.torn_files(spark, str(folder)).collect()} == {("torn.jsonl", len(f"{line('a')}\n{line('b')}\n".encode())), ("only.jsonl", 0)}
    assert [Path(x).name for x in keyed_log.repair(spark, str(folder), str(aside))] == ["only.jsonl", "torn.jsonl"]
    assert (folder / "torn.jsonl").read_text() == f"{line('a')}\n{line('b')}\n" and (folder / "open.jsonl").read_text() == texts["open"]
    assert sorted(p.read_text() for p in aside.glob("[!.]*.jsonl.*")) == sorted([texts["torn"], texts["only"]])
    assert keyed_log.repair(spark, str(folder), str(aside)) == []
    assert sorted(r["key"] for r in records.read_log(spark, str(folder)).collect()) == ["a", "b", "d", "e", "f"]


def test_manifest_of_files(spark, tmp_path):
    folder = tmp_path / "some data"
    (folder / "sub").mkdir(parents=True)
    for name, text in (("a.txt", b"one"), ("sub/b.txt", b"two"), ("c.csv", b"3"), ("none.txt", b"")):
        (folder / name).write_bytes(text)
    got = keyed_log.file_manifest(spark, str(folder))
    assert {r["path"]: (r["size"], r["digest"]) for r in got.collect()} == {n: (len(t), hashlib.sha256(t).hexdigest()) for n, t in (("a.txt", b"one"), ("sub/b.txt", b"two"), ("c.csv", b"3"))}
    recorded = spark.createDataFrame(got.collect(), got.schema)
    assert keyed_log.manifest_faults(spark, str(folder), recorded).count() == 0
    (folder / "a.txt").write_bytes(b"ONE")
    (folder / "new.txt").write_bytes(b"n")
    (folder / "c.csv").unlink()
    assert {(r["path"], r["fault"]) for r in keyed_log.manifest_faults(spark, str(folder), recorded).collect()} == {("a.txt", "changed"), ("new.txt", "unexpected"), ("c.csv", "missing")}


def test_manifest_of_large_files_is_made_by_blocks(spark, tmp_path):
    """Splits cut lines and blocks anywhere; lines may be long, empty, or not ended."""
    import random

    rng = random.Random(5)
    texts = {"a b.bin": rng.randbytes(70_001), "b.bin": b"\n" * 9000 + b"x" * 30_000 + b"\r\n", "c.bin": rng.randbytes(8000) + b"\n", "d.bin": b"PAR1\xff\xfe" + bytes(8000), "small.bin": b"one\n", "e.bin": b"y" * 4096, "f.bin": b"\xef\xbb\xbf" + b"ab\n" * 3000, "g.bin": b"\xef\xbb\xbf\n\n" + b"ab" * 3000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    whole = lambda t: hashlib.sha256(t).hexdigest()
    by_blocks = lambda t: whole(b"".join(hashlib.sha256(t[i : i + 4096]).digest() for i in range(0, len(t), 4096)))
    want = {n: (len(t), whole(t) if len(t) <= 4096 else by_blocks(t)) for n, t in texts.items()}
    for split in ("1000b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = {r["path"]: (r["size"], r["digest"]) for r in keyed_log.file_manifest(spark, str(tmp_path), block=4096).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want


def test_manifest_holds_no_large_file(spark, tmp_path):
    """Spark may make no value of over 64 MiB here; two files are larger, and tasks of their own take their bytes."""
    texts = {"a.parquet": bytes(range(256)) * (65 << 12), "b c.parquet": b"PAR1" + b"\n" * 5000 + (b"x" * (1 << 20) + b"\n") * 66 + b"y", "sub/small.parquet": b"one"}
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 64 << 20)
    try:
        got = {r["path"]: (r["size"], r["digest"]) for r in keyed_log.file_manifest(spark, str(tmp_path), "*.parquet").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {n: (len(t), hashlib.sha256(t).hexdigest()) for n, t in texts.items()}


def test_manifest_takes_bytes_as_they_are(spark, tmp_path):
    """Endings of codecs are no reason to decompress; a line of any length and a mark are bytes like others; bytes that were not read fail the job."""
    import gzip

    texts = {"whole.gz": gzip.compress(b"ab\n" * 9000, mtime=0), "blocks.gz": gzip.compress(hashlib.shake_256(b"s").digest(9000), mtime=0), "no.bz2": b"x\n" * 3000, "plain.bin": b"y\n" * 3001, "long.bin": b"a\n" + bytes(4000), "mark.bin": b"\xef\xbb\xbf" + b"ab\n" * 900}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    whole = lambda t: hashlib.sha256(t).hexdigest()
    by_blocks = lambda t: whole(b"".join(hashlib.sha256(t[i : i + 4096]).digest() for i in range(0, len(t), 4096)))
    want = {n: (len(t), whole(t) if len(t) <= 4096 else by_blocks(t)) for n, t in texts.items()}
    assert {r["path"]: (r["size"], r["digest"]) for r in keyed_log.file_manifest(spark, str(tmp_path), block=4096, whole=10).collect()} == want
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "plain.bin"))
    r = lines.select("_metadata.file_path").first()
    with pytest.raises(Exception, match="other bytes were read than the file has"):
        keyed_log._by_pieces(spark, lines, [Row(path="plain.bin", length=6010, file=r["file_path"])], 4096).collect()
