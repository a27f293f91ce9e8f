"""A keyed table whose appends cost what the batch costs, tables that are replaced by partition, and manifests of files.

Rows of a keyed table lie in buckets by a hash of their key, a folder each. An append reads the keys of the buckets that its rows
fall into and no others, and writes files into these. The number of buckets is a parameter of the table: with so many that
a batch meets few of them, an append reads little of the table, however long that has become.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import keyed
from .records import _one_per_key, exists, unfinished

BUCKETS = 256


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows, without the columns that place them. schema: of a table that may have none yet."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, bucket int, batch long")
    return reader.parquet(path).drop("bucket", "batch")


def touched(batch: DataFrame, buckets: int) -> list[int]:
    """Buckets, of a bounded number, in which rows of a batch belong."""
    return sorted(r["bucket"] for r in batch.select(bucket_of(F.col("key"), buckets).alias("bucket")).distinct().collect())


def append(rows: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> DataFrame:
    """Adds rows with new keys to the table at path and returns these; keys that other batches have put there stay as they are, and rows
    of one key that differ stop the job. A batch that runs again replaces what it wrote before."""
    spark = rows.sparkSession
    new = _one_per_key(rows).select(*rows.columns).withColumn("bucket", bucket_of(F.col("key"), buckets))
    kind = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    if exists(spark, path):
        there = spark.read.schema(kind).parquet(path).where(F.col("bucket").isin(touched(rows, buckets)) & (F.col("batch") != batch))
        new = new.join(there.select("bucket", "key"), ["bucket", "key"], "left_anti")
    # one file a bucket, whatever the batch's partitions
    out = new.withColumn("batch", F.lit(batch).cast("long")).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    return spark.read.schema(kind).parquet(path).where(F.col("batch") == batch).drop("bucket", "batch")


def replace_partitions(rows: DataFrame, path: str, by: str, stale: list[str] | None = None) -> None:
    """Puts rows in the place of those that the table at path has for the same values of by; all other files stay as they are, under
    their names. stale: values of which nothing is to stay, though rows has none. rows must not be read from those partitions."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if stale:
        kept = {r[by] for r in rows.select(by).where(F.col(by).isin(stale)).distinct().collect()}
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for value in set(stale) - kept:
            escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
            where = hadoop.Path(f"{path}/{by}={escaped}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def torn_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, size, keep) of the JSON-lines files at path whose last line was torn off: keep is the bytes before it."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("size"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    last = lines.groupBy("source", "size").agg(F.max_by("value", "at").alias("value"), F.sum(F.octet_length("value") + 1).alias("ended"))
    open_ = last.where((F.col("ended") > F.col("size")) & unfinished(F.col("value")))
    return open_.select("source", "size", (F.col("size") - F.octet_length("value")).alias("keep"))


def repair(spark: SparkSession, path: str, backup: str) -> list[str]:
    """Takes the torn ends off the files of a JSON-lines log, each kept aside whole in the folder backup; the names of the files.

    A stopped writer leaves one such file, so there are few. A file is put in place only when it is complete; a backup that
    is there already is not written over."""
    sc = spark.sparkContext
    hadoop, conf = sc._jvm.org.apache.hadoop, sc._jsc.hadoopConfiguration()
    found = []
    for r in torn_files(spark, path).orderBy("source").collect():
        source = hadoop.fs.Path(r["source"])
        fs = source.getFileSystem(conf)
        aside = hadoop.fs.Path(f"{backup}/{source.getName()}.{r['size']}")
        if not fs.exists(aside):
            hadoop.fs.FileUtil.copy(fs, source, aside.getFileSystem(conf), aside, False, conf)
        part = hadoop.fs.Path(source.getParent(), f".{source.getName()}.repaired")
        whole = sc._jvm.org.apache.commons.io.input.BoundedInputStream(fs.open(source), r["keep"])
        hadoop.io.IOUtils.copyBytes(whole, fs.create(part, True), 1 << 16, True)
        fs.delete(source, False)
        fs.rename(part, source)
        found.append(r["source"])
    return found


#: Bytes of a file that one task hashes at most.
BLOCK = 1 << 30
#: Bytes of a file that is one value while it is hashed, and of small blocks that a task takes together, at most.
WHOLE = 1 << 26
#: Bytes of a row at most, so that the 10,000 rows of an Arrow batch are some 40 MB.
PIECE = 1 << 12
#: A byte order mark, at the start of a file.
MARK = b"\xef\xbb\xbf"


def file_manifest(spark: SparkSession, path: str, glob: str = "*", block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(path, size, digest) of all files below path whose names fit: SHA-256 of their bytes, made on executors. path is relative to
    the folder; Spark's readers pass over empty files, so these are in no manifest. A file of up to whole bytes is one value while it is
    hashed; larger ones pass in pieces. SHA-256 is one chain, so the digest of a file of more than block bytes is the SHA-256 of its
    blocks' SHA-256s (32 bytes each, in order), and tasks share the file. Readers of lines would decompress files with a codec's
    ending, so these are one value at any size (Spark takes none over 2 GiB), as are files of up to block bytes that have a line
    of more than whole bytes."""
    whole = min(whole, block)
    sc = spark.sparkContext
    conf, hadoop = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)

    def reader(kind):
        return spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", glob)

    found = reader("binaryFile").load(path)
    out = found.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))
    large = found.where(F.col("length") > whole).select("path", "length", F.col("_metadata.file_path").alias("file")).collect()  # their contents are not read
    single = [r for r in large if codecs.getCodec(hadoop.fs.Path(r["path"])) is not None]
    named = {r["file"] for r in large} - {r["file"] for r in single}
    if named:
        lines = reader("text").option("lineSep", "\n").load(path).where(F.col("_metadata.file_size") > whole)
        # this reader passes over lines of more than whole bytes and holds no more of them
        passed = reader("text").option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", whole).load(path)
        read = passed.where((F.col("_metadata.file_size") > whole) & (F.col("_metadata.file_size") <= block)).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum(F.octet_length("value") + 1).alias("n"))
        n = {r["file"]: r["n"] for r in read.collect()}
        single += [r for r in large if r["file"] in named and r["length"] <= block and n.get(r["file"], 0) + len(MARK) < r["length"]]
    if single:
        values = spark.read.format("binaryFile").load([_escaped(r["path"]) for r in single])
        parts = F.transform(F.sequence(F.lit(0), ((F.col("length") - 1) / block).cast("int")), lambda k: F.sha2(F.substr("content", k * block + 1, F.lit(block)), 256))
        out = out.union(values.select("path", F.col("length").alias("size"), _of_blocks(parts).alias("digest")))
    if len(large) > len(single):
        lines = lines.where(~F.col("_metadata.file_path").isin([r["file"] for r in single]))
        out = out.union(_by_pieces(spark, lines, sorted(set(large) - set(single)), block))
    folder = hadoop.fs.Path(path)
    root = folder.getFileSystem(conf).makeQualified(folder).toString()
    return out.withColumn("path", F.substring("path", len(root) + 2, 1 << 20))


def _escaped(name: str) -> str:
    """A file's name as a reader takes it, in which signs of patterns stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def _of_blocks(digests: Column) -> Column:
    """A file's digest from those of its blocks, in hexadecimal digits."""
    return F.when(F.size(digests) == 1, digests[0]).otherwise(F.sha2(F.unhex(F.array_join(digests, "")), 256))


def _by_pieces(spark: SparkSession, lines: DataFrame, files: list, block: int) -> DataFrame:
    """(path, size, digest) of larger files, (path, length, file) each. Their bytes are read as lines, in splits; where a split's first
    line lies follows from the lengths of the lines of the splits before it. Pieces go to their block's task in order and are
    hashed as they come, so a task holds a batch of pieces and what its sort may; a long line is held by its reader."""
    at_block, of, filled = {}, [], WHOLE
    for r in files:
        at_block[r["file"]] = (len(of), r["length"])
        for start in range(0, r["length"], block):
            n = min(block, r["length"] - start)
            task, filled = (of[-1][1], filled + n) if filled + n <= WHOLE else (of[-1][1] + 1 if of else 0, n)
            of.append((len(of), task, r["path"], r["length"]))
    tasks = [x[1] for x in of]
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("line"))
    long = lines.groupBy("file", "size", "split").agg(F.sum(F.octet_length("line") + 1).cast("long").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.sum("n").over(Window.partitionBy("file")) < F.col("size"), len(MARK)).otherwise(0)  # which readers of text pass over
    starts = long.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) + mark).cast("long").alias("at"))  # a row a split

    def pieces(batches):
        import pyarrow as pa

        def cut(file, at, data):
            first, size = at_block[file]
            data = data[: max(size - at, 0)]  # nothing need end the last line
            rows, i = [], 0
            while i < len(data):
                n, b = min(PIECE, block - (at + i) % block), first + (at + i) // block
                rows.append((tasks[b], b, at + i, data[i : i + n]))
                i += n
            return rows

        here, at = None, 0
        for b in batches:
            keys, values = list(zip(b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("at").to_pylist(), strict=True)), b.column("line").to_pylist()
            i, rows = 0, []
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                data = b"\n".join(values[i:j]) + b"\n"
                if keys[i][:2] != here:
                    here, at = keys[i][:2], keys[i][2]
                    if at == len(MARK) and here[1] == 0:
                        data, at = MARK + data, 0
                rows += cut(here[0], at, data)
                at += len(data)
                i = j
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["task", "block", "at", "piece"])

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        known: dict[int, list] = {}
        for b in batches:
            for k, piece in zip(b.column("block").to_pylist(), b.column("piece"), strict=True):
                x = known.setdefault(k, [hashlib.sha256(), 0])
                x[0].update(piece.as_buffer())
                x[1] += len(piece.as_buffer())
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int32()), pa.array([x[1] for x in known.values()], pa.int64()), pa.array([x[0].hexdigest() for x in known.values()])], names=["block", "n", "digest"])

    cuts = lines.join(F.broadcast(starts), ["file", "split"]).select("file", "split", "at", "line").mapInArrow(pieces, "task int, block int, at long, piece binary")
    each = cuts.repartitionById(tasks[-1] + 1, F.col("task")).sortWithinPartitions("block", "at").mapInArrow(hashed, "block int, n long, digest string")
    rows = spark.createDataFrame(of, "block int, task int, path string, size long").join(each, "block", "left").groupBy("path", "size")
    found = rows.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("x"))  # 64 digits a block
    unlike = F.raise_error(F.concat(F.lit("other bytes were read than the file has: "), F.col("path"))).cast("string")
    return found.select("path", "size", F.when(F.col("n") == F.col("size"), _of_blocks(F.col("x")["digest"])).otherwise(unlike).alias("digest"))


def manifest_faults(spark: SparkSession, path: str, recorded: DataFrame, glob: str = "*") -> DataFrame:
    """Files that came, went or changed since recorded, a file_manifest(), was made."""
    return keyed.manifest_faults(file_manifest(spark, path, glob), recorded)
