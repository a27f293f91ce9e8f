"""Logs, manifests and records, and seeded tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import keyed
from ..sources import adapters as A
from ..sources import generators, keyed_log, records
from ..sources.adapters import scratch
from . import query


@query("log_load", A.SQL + "SELECT key, answer, p_yes, config FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1")
def log_load(spark, sf_dir):
    """A JSON-lines log written from the documents and read back with its checks."""
    rows = A.log(spark, sf_dir)
    lines = keyed.first_per_key(rows, ["key"], ["ord"]).select(F.to_json(F.struct("key", "answer", "p_yes", "config")).alias("value"))
    return records.parsed_log(lines)


@query("manifest_check", A.SQL + "SELECT coalesce(a.path, e.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' ELSE 'changed' END AS fault FROM (SELECT doc_id AS path, sha256(text) AS d FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id AS path, CASE WHEN doc_id % 10 = 4 THEN '' ELSE sha256(text) END AS d FROM documents WHERE doc_id % 10 <> 5) e ON a.path = e.path WHERE a.d IS DISTINCT FROM e.d")
def manifest_check(spark, sf_dir):
    docs = A.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    expected = docs.where("path % 10 <> 5").withColumn("digest", F.when(F.col("path") % 10 == 4, "").otherwise(F.col("digest")))
    return keyed.manifest_faults(docs.where("path % 10 <> 3"), expected)


@query("file_manifest")
def file_manifest(spark, sf_dir):
    """Size and SHA-256 of every Parquet file of the tables, made on executors."""
    return keyed_log.file_manifest(spark, sf_dir, "*.parquet")


@query("keyed_append", A.SQL + """, f AS (SELECT key, min(ord) AS ord FROM log WHERE ord % 100 <> 7 GROUP BY key), g AS (SELECT key, min(ord) AS ord FROM log WHERE ord % 100 < 9 GROUP BY key)
SELECT 'kept' AS part, count(*) AS n, sum(ord)::BIGINT AS ords FROM f UNION ALL SELECT 'added', count(*), coalesce(sum(ord), 0)::BIGINT FROM g WHERE key NOT IN (SELECT key FROM f)""")
def keyed_append(spark, sf_dir):
    """A keyed table of the log's rows to which a second batch is added, most of which is there already: what was kept, what came."""
    rows = A.log(spark, sf_dir).select("key", "ord")
    once = lambda df: keyed.first_per_key(df, ["key"], ["ord"])
    path = scratch(spark, "keyed")
    first = keyed_log.append(once(rows.where("ord % 100 <> 7")), path, 0, 16)
    added = keyed_log.append(once(rows.where("ord % 100 < 9")), path, 1, 16)
    told = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum("ord"), F.lit(0)).alias("ords"))
    return told(first, "kept").union(told(added, "added"))


@query("replace_config", A.SQL + "SELECT config, key, CASE WHEN config IN ('src1', 'src2') THEN -ord ELSE ord END AS ord FROM log WHERE config <> 'src3'")
def replace_config(spark, sf_dir):
    """A table by configuration in which two configurations are replaced in place and one is emptied."""
    rows = A.log(spark, sf_dir).select("config", "key", "ord")
    path = scratch(spark, "configs")
    rows.repartition("config").write.partitionBy("config").parquet(path)
    again = rows.where(F.col("config").isin("src1", "src2")).withColumn("ord", -F.col("ord"))
    keyed_log.replace_partitions(again, path, "config", ["src3"])
    return spark.read.schema("key string, ord long, config string").parquet(path).select("config", "key", "ord")


_IDENTITY = "'{\"answer\": \"' || lang || '\", \"config\": \"' || source || '\"}'"


@query("identity_check", f"SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 'key' ELSE 'n_chars' END AS fault FROM documents WHERE doc_id % 97 = 5 AND sha256({_IDENTITY}) <> sha256('') OR doc_id % 89 = 7 AND n_chars + 1 <> length(text) AND doc_id % 97 <> 5")
def identity_check(spark, sf_dir):
    """Rows whose stored key or length does not follow from their content, in a log of which some rows were altered."""
    key = F.sha2(scores.canonical_json({"answer": F.col("lang"), "config": F.col("source")}), 256)
    stored = A.read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "text", F.when(F.col("doc_id") % 97 == 5, F.sha2(F.lit(""), 256)).otherwise(key).alias("key"),
        F.when(F.col("doc_id") % 89 == 7, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"),
    )
    fault = F.when(F.col("key") != key, "key").when(F.col("n_chars") != F.length("text"), "n_chars")
    return stored.select("doc_id", fault.alias("fault")).where("fault is not null")


@query("reverify", "SELECT l_orderkey AS block_id, l_linenumber AS position FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice - l_quantity * p_retailprice) > 1e-4")
def reverify(spark, sf_dir):
    """Stored values that differ from recomputed ones by more than a tolerance."""
    joined = A.read(spark, sf_dir, "lineitem").join(A.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    wrong = joined.where(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) > 1e-4)
    return wrong.select(F.col("l_orderkey").alias("block_id"), F.col("l_linenumber").alias("position"))


@query("record_validate", "SELECT * FROM (VALUES ('test', 'not fitted on the calibration split'), ('less', 'counts do not sum to n'), ('zero', 'counts are not positive integers'), ('tau', 'S1.tau is not in [0, 1]'), ('delta', 'S2.delta is not in [0, 1]'), ('none', 'n is missing')) v(record, fault)")
def record_validate(spark, sf_dir):
    """Faults of a calibration record made from this data (none), and of altered ones."""
    from .decisions import fitted_s1

    counts = {r["split"]: r["count"] for r in A.blocks(spark, sf_dir).groupBy("split").count().collect()}
    tau = fitted_s1(spark, sf_dir).first()["tau"]
    good = {"split": "calib", "n": sum(counts.values()), "counts": counts, "thresholds": {"S1": {"tau": tau}, "S2": {"tau": tau, "delta": 0.05}}}
    altered = {
        "good": good, "test": good | {"split": "test"}, "less": good | {"n": good["n"] - 1}, "zero": good | {"counts": counts | {"dev": 0}},
        "tau": good | {"thresholds": {"S1": {"tau": 1.5}}}, "delta": good | {"thresholds": {"S2": {"tau": tau}}}, "none": {k: v for k, v in good.items() if k != "n"},
    }
    return spark.createDataFrame([(k, x) for k, r in altered.items() for x in records.record_faults(r)], "record string, fault string")


_RUNS = """WITH r AS (SELECT source, count(*) AS n, min(lang) AS lang, sum(n_chars)::BIGINT AS chars, CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER) % 5 AS k FROM documents GROUP BY source),
f AS (SELECT source, unnest(CASE k WHEN 0 THEN [] WHEN 1 THEN ['n differs'] WHEN 2 THEN ['chars is missing', 'seed is unknown'] WHEN 3 THEN ['lang differs', 'n differs'] ELSE ['seed is unknown'] END) AS fault FROM r)"""


@query("run_records", _RUNS + " SELECT source, fault FROM f")
def run_records(spark, sf_dir):
    """Faults of the records of runs, one a source, against what the documents say; the records of most sources were altered."""
    runs = A.read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("lang").alias("lang"), F.sum("n_chars").alias("chars"))
    k = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 5
    text = lambda c: F.col(c).cast("string")
    expected = F.create_map(F.lit("n"), text("n"), F.lit("lang"), text("lang"), F.lit("chars"), text("chars"))
    other = F.create_map(F.lit("n"), (F.col("n") + F.when(k.isin(1, 3), 1).otherwise(0)).cast("string"), F.lit("lang"), F.when(k == 3, "none").otherwise(F.col("lang")), F.lit("chars"), text("chars"), F.lit("seed"), F.lit("1"))
    record = F.map_filter(other, lambda name, _: ~((name == "seed") & ~k.isin(2, 4)) & ~((name == "chars") & (k == 2)))
    return runs.select("source", F.explode(keyed.map_faults(record, expected)).alias("fault"))


#: The families of each split under the fixed seed.
SPLITS = {
    "dev": "ellipse dshape cross tube", "calib": "square rect tee ell notched trapezoid gear", "test": "circle obround polygon double_d star keyed chamfered",
}


@query("splits", A.SQL + A.OUTLINES + ", s AS (SELECT unnest(string_split(f, ' ')) AS family, split FROM (VALUES " + ", ".join(f"('{s}', '{f}')" for s, f in SPLITS.items()) + ") v(split, f)) SELECT family, split, sum(n)::BIGINT AS n FROM outlines JOIN s USING (family) GROUP BY ALL")
def splits(spark, sf_dir):
    """The seeded split of the parts' families, with how many parts each has."""
    counts = A.outlines(spark, sf_dir).groupBy("family").agg(F.sum("n").alias("n"))
    dealt = generators.family_splits(r["family"] for r in counts.select("family").collect())  # as many as there are places
    split = F.element_at(F.create_map(*(F.lit(x) for pair in dealt.items() for x in pair)), F.col("family"))
    return counts.select("family", split.alias("split"), "n")


@query("shuffle")
def shuffle(spark, sf_dir):
    """Presentation order of each block's candidates, seeded by the block."""
    blocks = A.candidates(spark, sf_dir).groupBy("block_id").agg(F.sort_array(F.collect_list("cand_id")).alias("cands"))
    return generators.presented(blocks)


@query("panel")
def panel(spark, sf_dir):
    """The pilot panel of those parts' outlines that are of the development families, some fourteen: five categories, each pair with
    its label and margin, and how many parts the peg stands for."""
    import json

    from ..operators import polygons as P

    split = generators.family_splits(generators.SIZES)
    there = A.outlines(spark, sf_dir).where(F.col("family").isin([f for f, x in split.items() if x == "dev"]))
    counts = {r["variant"]: r["n"] for r in there.groupBy(F.substring_index("part_id", "@", 1).alias("variant")).agg(F.sum("n").alias("n")).collect()}  # variants of four families
    dev = [p for p in generators.part_list() if p[0] in counts]
    profiled = P.profiles(spark.createDataFrame(dev, "part_id string, family string, params string"))
    found = {(r["peg_id"], r["socket_id"]): (r["label"], r["margin"]) for r in P.label_matrix(profiled).collect()}  # a row a pair of them
    outlines = {i: P.outline(f, json.loads(p)) for i, f, p in dev}
    symmetric = {i for i, (pts, hole) in outlines.items() if not P.turned_differs(P.bore_of(pts, hole)[0])}
    ids, rows = [i for i, _, _ in dev], []
    for category, peg, socket in generators.panel(ids, found, {i: f for i, f, _ in dev}, symmetric, -P.CAP):
        if category == "shrunk":
            pts, hole = outlines[peg]
            by = float(socket.rsplit("_c", 1)[1])
            ring = P.offset_ring(pts, by)
            ring, pin = ring - P.area_centre(ring)[0], max(0.0, hole - by) if hole else 0.0
            margin = max(P.fit_of(t, hole, ring, pin)[0] for t in P.quarter_turns(pts))
            label = "compatible" if margin >= P.BAND else "ambiguous" if margin >= -P.BAND else "incompatible"
        else:
            label, margin = found[peg, peg if category == "rotated" else socket]
        rows.append((category, peg, socket, label, float(margin), counts[peg]))
    return spark.createDataFrame(rows, "category string, peg_id string, socket string, label string, margin double, n long")


_MASK = """, a AS (SELECT w::INTEGER AS a, h::INTEGER AS b, (part_id % 7 - 3)::INTEGER AS change, count(*) AS n FROM shapes GROUP BY ALL),
t AS (SELECT *, greatest(b + change, 0) - CASE turn WHEN 0 THEN a ELSE b END AS dx, greatest(a + change, 0) - CASE turn WHEN 0 THEN b ELSE a END AS dy FROM a, (SELECT unnest([0, 90]) AS turn)),
m AS (SELECT *, CASE WHEN dx >= 0 AND dy >= 0 THEN least(dx, dy) + 1 ELSE -sqrt(greatest(-dx, 0) ** 2 + greatest(-dy, 0) ** 2) END AS margin FROM t)
"""


@query("mask_margin", A.SQL + _MASK + "SELECT a, b, change, any_value(n) AS n, round(max(margin), 9) AS margin_px, arg_min(turn, (-margin, turn))::INTEGER AS turn FROM m GROUP BY ALL")
def mask_margin(spark, sf_dir):
    """Masks of parts, (2 a + 1) by (2 b + 1) pixels, in masks of openings that lie across and are larger or smaller by change: best margin and turn."""
    import numpy as np

    from ..operators import polygons as P

    def run(batches):
        import pyarrow as pa

        def box(half, i, j):
            x = np.arange(-half, half + 1)
            return (np.abs(x)[None, :] <= i) & (np.abs(x)[:, None] <= j)

        for batch in batches:
            rows = []
            for a, b, change in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "change")), strict=True):
                i, j = max(b + change, 0), max(a + change, 0)
                half = max(a, b, i, j) + 1
                rows.append(P.best_turn_margin(box(half, a, b), box(half, i, j)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32())], names=[*batch.schema.names, "margin_px", "turn"])

    shape = A.shapes(spark, sf_dir).groupBy(F.col("w").cast("int").alias("a"), F.col("h").cast("int").alias("b"), (F.col("part_id") % 7 - 3).cast("int").alias("change")).agg(F.count("*").alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = shape.repartition(n, "a", "b", "change").mapInArrow(run, "a int, b int, change int, n long, margin_px double, turn int")
    return out.withColumn("margin_px", F.round("margin_px", 9))
