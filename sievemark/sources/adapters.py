"""The engine's tables, as deterministic projections of the star-schema test tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import generators

#: Groups that are reported apart.
EXPOSED = ("NATION_0", "NATION_3", "NATION_6", "NATION_9", "NATION_12", "NATION_15", "NATION_18")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a large table that a task sorts or joins at once.
TASK_ROWS = 100_000

#: Rows for up to so many tasks are written to each one's file as they come (Spark's default, spark.shuffle.sort.bypassMergeThreshold);
#: for more, a task first holds all rows that it deals.
HELD_BEYOND = 200


def tasks(spark: SparkSession, total: int) -> int:
    """How many tasks total rows are dealt to: TASK_ROWS each (and no fewer than cores), up to twice that where HELD_BEYOND tasks then do."""
    cores = spark.sparkContext.defaultParallelism
    n = max(cores, -(-total // TASK_ROWS))
    if n <= HELD_BEYOND:
        return n
    if n <= 2 * HELD_BEYOND:
        return max(cores, HELD_BEYOND)
    return -(-n // HELD_BEYOND) * HELD_BEYOND  # each of the HELD_BEYOND first tasks then deals to its own few


def dealt(rows: DataFrame, total: int, *key: str) -> DataFrame:
    """The rows of a file, total in number, dealt by key to tasks(): what a sort or join by that key holds does not grow with the table.
    (Partitions that Spark is free to join grow up to 64 MB as compressed.) The task that reads a split of the file does not hold it,
    either: rows for more than HELD_BEYOND tasks are dealt to HELD_BEYOND first, and only a task of these holds its share."""
    n = tasks(rows.sparkSession, total)
    if n <= HELD_BEYOND:
        return rows.repartition(n, *key)
    other = {k: f"{k}_dealt" for k in key}  # Spark leaves out a deal that is followed by another at once
    again = rows.repartition(HELD_BEYOND, *key).withColumnsRenamed(other).repartition(n, *other.values())
    return again.withColumnsRenamed({v: k for k, v in other.items()})


def scratch(spark: SparkSession, label: str) -> str:
    """A new name in the folder that driver and executors share; it goes when the JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    path = f"{root}/sievemark-{uuid.uuid4().hex}-{label}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scored candidate of a block: block_id, position, cand_id, answer, top_prob, p_yes, mass_yes, mass_no, price."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    items = read(spark, sf_dir, "lineitem")
    items = dealt(items.select("l_orderkey", *order, "l_returnflag"), items.count(), "l_orderkey")
    position = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    p = F.col("l_quantity") / F.lit(50.0)
    answer = F.when((F.col("l_tax") == 0.08) & (F.col("l_linenumber") == 7), "other").when(F.col("l_returnflag") == "N", "no").otherwise("yes")
    return items.select(
        F.col("l_orderkey").alias("block_id"), position.alias("position"), F.lpad(position.cast("string"), 3, "0").alias("cand_id"), answer.alias("answer"),
        (F.lit(0.5) + F.lit(5.0) * F.col("l_discount")).alias("top_prob"), p.alias("p_yes"), (p * (1 - F.col("l_tax"))).alias("mass_yes"),
        ((1 - p) * (1 - F.col("l_tax"))).alias("mass_no"), F.col("l_extendedprice").alias("price"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block: block_id, family, split, tier, regime, has_mate."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    mate = F.col("o_orderkey") % 2 == 0
    tier = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "hard").otherwise("easy")
    split = F.when(F.col("n_regionkey") % 3 == 0, "dev").when(F.col("n_regionkey") % 3 == 1, "calib").otherwise("test")
    total = orders.count()
    one, two = dealt(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), total, "o_custkey"), dealt(customer.select("c_custkey", "c_nationkey"), total, "c_custkey")
    joined = one.join(two, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # a few places
    return joined.select(
        F.col("o_orderkey").alias("block_id"), F.col("n_name").alias("family"), split.alias("split"), tier.alias("tier"),
        F.concat(F.when(mate, "present_").otherwise("absent_"), tier).alias("regime"), mate.alias("has_mate"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with what their block says, and label: the dearest candidate is the mate where there is one."""
    n = tasks(spark, read(spark, sf_dir, "lineitem").count())
    of_block = blocks(spark, sf_dir).repartition(n, "block_id")  # as candidates() are; the tasks that deal these are of bounded size already
    cand = candidates(spark, sf_dir).join(of_block, "block_id")
    best = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("price"), "position"))
    return cand.withColumn("label", F.when(F.col("has_mate") & (best == 1), "compatible").otherwise("incompatible"))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rung of a ladder: peg_id, family, split, offset_mm, margin_mm, p_yes, answer, label, image_fits."""
    events = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    margin = F.greatest(F.lit(-2.0), (k - 50) / F.lit(20.0))
    offset = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    label = F.when(margin >= 0.05, "compatible").when(margin >= -0.05, "ambiguous").otherwise("incompatible")
    return events.select(
        F.col("user_id").alias("peg_id"), (F.col("user_id") % 7).alias("family"), F.when(F.col("user_id") % 2 == 0, "calib").otherwise("test").alias("split"),
        offset.alias("offset_mm"), margin.alias("margin_mm"), F.least(F.lit(1.0), F.col("value") / F.lit(100.0)).alias("p_yes"),
        F.when(F.col("event_id") % 3 == 0, "yes").otherwise("no").alias("answer"), label.alias("label"), (k % 2 == 0).cast("int").alias("image_fits"),
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rectangular part: part_id, split, family, w, h, bore_w, bore_h."""
    part = read(spark, sf_dir, "part")
    w, h = F.col("p_size").cast("double"), (1 + F.col("p_partkey") % 37).cast("double")
    return part.select(
        F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("split"), F.col("p_type").alias("family"),
        w.alias("w"), h.alias("h"), (w + 0.6).alias("bore_w"), (h + 0.6).alias("bore_h"),
    )


def _step() -> Column:
    return (F.ceil(F.col("p_size") / 10) * 10).cast("int")


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct outlines that parts have: part_id, family, params, size, scale, n parts, and the first of them. A part has the outline of
    the catalogue that its number says, at the scale that its size, in steps of 10, says."""
    known = generators.part_list()
    variant = F.get(F.array(*(F.struct(F.lit(i).alias("variant"), F.lit(f).alias("family"), F.lit(p).alias("params")) for i, f, p in known)), (F.col("p_partkey") % len(known)).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.explode(F.array(variant)).alias("v"), _step().alias("size"), "p_partkey")
    rows = rows.groupBy("v.variant", "v.family", "v.params", "size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    scale = F.lit(0.5) + F.col("size") / F.lit(100.0)
    return rows.select(F.concat("variant", F.lit("@"), F.col("size").cast("string")).alias("part_id"), "family", "params", "size", scale.alias("scale"), "n", "first")


def outline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(peg_id, socket_id, n_pairs): outlines of parts of one catalogue (brand, type and size), and how many pairs of parts that are."""
    n = len(generators.part_list())
    ids = F.array(*(F.lit(i) for i, _, _ in generators.part_list()))
    place = ["p_brand", "p_type", "size"]
    rows = read(spark, sf_dir, "part").withColumn("size", _step()).groupBy(*place, (F.col("p_partkey") % n).alias("k")).agg(F.count("*").alias("n"))
    name = lambda k: F.concat(F.get(ids, F.col(k).cast("int")), F.lit("@"), F.col("size").cast("string"))
    pegs, sockets = rows.select(*place, F.col("k").alias("a"), F.col("n").alias("na")), rows.select(*place, F.col("k").alias("b"), F.col("n").alias("nb"))
    return pegs.join(sockets, place).groupBy(name("a").alias("peg_id"), name("b").alias("socket_id")).agg(F.sum(F.col("na") * F.col("nb")).alias("n_pairs"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed score log: ord, key, answer, p_yes."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("key"), F.col("lang").alias("answer"),
        (F.col("n_chars") % 100 / F.lit(100.0)).alias("p_yes"), F.col("source").alias("config"),
    )


#: The same tables for DuckDB, to be put before an oracle's SELECT.
SQL = """
WITH cand0 AS (SELECT l_orderkey AS block_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS position,
  CASE WHEN l_tax = 0.08::DOUBLE AND l_linenumber = 7 THEN 'other' WHEN l_returnflag = 'N' THEN 'no' ELSE 'yes' END AS answer,
  0.5::DOUBLE + 5::DOUBLE * l_discount AS top_prob, l_quantity / 50::DOUBLE AS p_yes, (l_quantity / 50::DOUBLE) * (1 - l_tax) AS mass_yes, (1 - l_quantity / 50::DOUBLE) * (1 - l_tax) AS mass_no, l_extendedprice AS price FROM lineitem),
cand AS (SELECT *, lpad(position::VARCHAR, 3, '0') AS cand_id FROM cand0),
qry AS (SELECT o_orderkey AS block_id, n_name AS family, CASE n_regionkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'calib' ELSE 'test' END AS split,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hard' ELSE 'easy' END AS tier, o_orderkey % 2 = 0 AS has_mate,
  (CASE WHEN o_orderkey % 2 = 0 THEN 'present_' ELSE 'absent_' END) || (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hard' ELSE 'easy' END) AS regime
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
lab AS (SELECT cand.*, family, split, tier, has_mate, regime, CASE WHEN has_mate AND cand_id = (arg_max(cand_id, struct_pack(p := price, q := -position)) OVER (PARTITION BY cand.block_id)) THEN 'compatible' ELSE 'incompatible' END AS label FROM cand JOIN qry USING (block_id)),
ladder AS (SELECT user_id AS peg_id, user_id % 7 AS family, CASE WHEN user_id % 2 = 0 THEN 'calib' ELSE 'test' END AS split, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS offset_mm,
  greatest(-2::DOUBLE, (k - 50) / 20::DOUBLE) AS margin_mm, least(1::DOUBLE, value / 100::DOUBLE) AS p_yes, CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'no' END AS answer, (k % 2 = 0)::INTEGER AS image_fits,
  CASE WHEN greatest(-2::DOUBLE, (k - 50) / 20::DOUBLE) >= 0.05::DOUBLE THEN 'compatible' WHEN greatest(-2::DOUBLE, (k - 50) / 20::DOUBLE) >= -0.05::DOUBLE THEN 'ambiguous' ELSE 'incompatible' END AS label
  FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)),
shapes AS (SELECT p_partkey AS part_id, p_brand AS split, p_type AS family, p_size::DOUBLE AS w, (1 + p_partkey % 37)::DOUBLE AS h, p_size::DOUBLE + 0.6::DOUBLE AS bore_w, (1 + p_partkey % 37)::DOUBLE + 0.6::DOUBLE AS bore_h FROM part),
log AS (SELECT doc_id AS ord, sha256(text) AS key, lang AS answer, (n_chars % 100) / 100::DOUBLE AS p_yes, source AS config FROM documents)
"""

#: The outlines of parts for DuckDB, to follow the tables above.
OUTLINES = ", known AS (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES " + ", ".join(f"('{i}', '{f}', '{p}')" for i, f, p in generators.part_list()) + """) v(variant, family, params)),
outlines AS (SELECT variant || '@' || (ceil(p_size / 10) * 10)::INTEGER AS part_id, family, params, (ceil(p_size / 10) * 10)::INTEGER AS size, count(*) AS n, min(p_partkey) AS first FROM part JOIN known ON k = p_partkey % (SELECT count(*) FROM known) GROUP BY ALL)"""
