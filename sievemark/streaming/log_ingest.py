"""Streaming ingestion of a keyed log (an extension: the batch log is append-only and resumable).

Each micro-batch adds what is new by key to a table in buckets, of which it reads the keys of those that it touches; what it
writes is marked by its number, so neither a restarted stream nor a batch that is run again repeats rows. Of rows of a key
that come in one batch the smallest stays. Lines that do not parse go to a side table, by batch too, rather than being lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keyed
from ..sources import keyed_log
from ..sources.records import LOG


def ingest(spark: SparkSession, folder: str, table: str, rejected: str, checkpoint: str, schema: str = LOG, buckets: int = keyed_log.BUCKETS):
    """Starts a stream from JSON-lines files in folder to a keyed table; ends when all files are read."""
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    lines = spark.readStream.text(folder).where(F.trim("value") != "").select("value", parsed.alias("r"))

    def put(batch: DataFrame, number: int) -> None:
        good = batch.where("r._bad is null and r.key is not null").select("r.*").drop("_bad")
        good = keyed.first_per_key(good, ["key"], good.columns)
        keyed_log.append(good, table, number, buckets)
        batch.where("r._bad is not null or r.key is null").select("value").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
