"""What the corpus operators share: tables, scratch tables, word splitting, connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A to Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A key that more than one row in so many has is hot.
HOT = 1000


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; only space and \\x09-\\x0D separate. Null: none."""
    return text.translate(LOWER).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores before it as long as a column is called so (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured, a temporary one if there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="sievemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder (a folder for each value of by) and read back: later stages
    survive lost executors and nothing is computed twice. The files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sievemark-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path, partitionBy=by)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = where
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    df._stored_at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(df._stored_at, True)


def shipped(spark: SparkSession, model) -> Broadcast:
    """A bounded model for all executors, pickled by value: they need not have this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(sent: Broadcast):
    return pickle.loads(sent.value)


def total(df: DataFrame, expr) -> int:
    return int(df.agg(F.sum(expr).alias("n")).first()["n"] or 0)


def looked_up(rows: DataFrame, values: DataFrame, on: str, weight: str, rows_total: int) -> DataFrame:
    """rows left-joined with values, which have each key once and in weight how many of the rows_total rows have it.

    Keys of more than one row in HOT, so fewer than HOT keys, are broadcast and their rows stay where they are; the others
    are shuffled, with at most one row in HOT a key. Both are read twice, so they should be stored tables; no key is null."""
    often = F.broadcast(values.where(F.col(weight) > rows_total // HOT))
    near = rows.join(often, on)
    rest = rows.join(often.select(on), on, "left_anti").join(values.where(F.col(weight) <= rows_total // HOT), on, "left")
    return near.unionByName(rest)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it is connected with.

    Alternating large-star and small-star rounds; each is two aggregations and joins on the edge
    list, so neither a component nor the list of links ever meets in one task or on the driver.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), label)
    seen = None
    while True:
        both = now.union(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = large.where("node <> root").distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.explode(F.array(F.struct("root", "m"), F.struct(F.col("node").alias("root"), "m"))).alias("x"))
        small = small.select(F.col("x.root").alias("node"), F.col("x.m").alias("root")).where("node <> root").distinct()
        before, now = now, stored(small, label)
        discard(before)
        state = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("node", "root"), F.lit(1 << 40))).alias("h")).first()
        if state == seen:
            return now
        seen = state
