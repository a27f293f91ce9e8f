"""Filters, joins, deduplication and set operations on logs and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import evaluate, keyed
from ..operators.decide import decide_all
from ..sources import adapters as A
from . import decisions, query


@query("split_filter", A.SQL + "SELECT block_id, split FROM qry WHERE split <> 'test'")
def split_filter(spark, sf_dir):
    return A.blocks(spark, sf_dir).where(F.col("split").isin("dev", "calib")).select("block_id", "split")


@query("tier_filter", A.SQL + "SELECT block_id, regime FROM qry WHERE regime LIKE '%hard'")
def tier_filter(spark, sf_dir):
    return A.blocks(spark, sf_dir).where(F.endswith("regime", F.lit("hard"))).select("block_id", "regime")


@query("exposed_groups", A.SQL + f"SELECT exposed, count(*) AS n FROM (SELECT list_contains({list(A.EXPOSED)}, family) AS exposed FROM qry) GROUP BY exposed")
def exposed_groups(spark, sf_dir):
    return A.blocks(spark, sf_dir).groupBy(F.col("family").isin(*A.EXPOSED).alias("exposed")).agg(F.count("*").alias("n"))


@query("path_rewrite", "SELECT page_id, 'arms/alt/' || string_split(url, '/')[-1] AS path FROM pages")
def path_rewrite(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", scores.file_in(F.col("url"), "arms/alt").alias("path"))


@query("config_merge", """SELECT doc_id, '{"quant":"nf4","prompt":"' || source || '","views":"two"}' AS config FROM documents""")
def config_merge(spark, sf_dir):
    """Right-biased merge of settings without one key."""
    base = F.create_map(*map(F.lit, ("quant", "nf4", "prompt", "paper", "arm", "a")))
    over = F.create_map(F.lit("prompt"), F.col("source"), F.lit("views"), F.lit("two"))
    kept = F.map_filter(base, lambda k, _: (k != "arm") & ~F.map_contains_key(over, k))
    return A.read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.map_concat(kept, over)).alias("config"))


@query("default_fill", "SELECT doc_id, CASE WHEN lang IS NULL OR lang = 'es' THEN 'default' ELSE lang END AS chat FROM documents")
def default_fill(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif("lang", F.lit("es")), F.lit("default")).alias("chat"))


@query("join_scores", "SELECT l_orderkey AS block_id, l_linenumber AS position, o_orderpriority AS label, o_totalprice AS score FROM lineitem, orders WHERE l_orderkey = o_orderkey")
def join_scores(spark, sf_dir):
    items = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_linenumber").alias("position"))
    orders = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_id"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("score"))
    return keyed.joined_complete(items, orders, "block_id")


@query("join_content_key", A.SQL + "SELECT a.ord, sha256('{\"answer\": \"' || a.answer || '\", \"config\": \"' || a.config || '\"}') AS key, count(*) AS partners FROM log a JOIN log b ON a.answer = b.answer AND a.config = b.config GROUP BY a.ord, a.answer, a.config")
def join_content_key(spark, sf_dir):
    """Join on the digest of a canonical text of the identity; partners are counted per key, not paired."""
    key = F.sha2(scores.canonical_json({"config": F.col("config"), "answer": F.col("answer")}), 256)
    rows = A.log(spark, sf_dir).select("ord", key.alias("key"))
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("partners")), "key").select("ord", "key", "partners")


_IMAGES = """WITH img AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 50 <> 7),
r AS (SELECT l_orderkey AS block_id, l_linenumber AS position, min(l_returnflag) AS config, min([l_partkey % 40, l_suppkey % 60, l_partkey % 80, 3]) AS paths FROM lineitem GROUP BY ALL),
e AS (SELECT block_id, position, config, unnest(paths) AS path, unnest(range(0, 4)) AS place FROM r),
d AS (SELECT block_id, position, config, list(digest ORDER BY place) AS digests, coalesce(string_agg(place::VARCHAR, ',' ORDER BY place) FILTER (digest IS NULL), '') AS unknown FROM e LEFT JOIN img ON img.path = e.path GROUP BY ALL)
"""


@query("pair_key", _IMAGES + """SELECT block_id, position, unknown, CASE WHEN unknown = '' THEN sha256('{"config": "' || config || '", "image_sha": ["' || array_to_string(digests, '", "') || '"]}') END AS key FROM d""")
def pair_key(spark, sf_dir):
    """Content key over a row's identity and the digests of its four images, in order; without one where an image is unknown."""
    images = A.read(spark, sf_dir, "documents").where("doc_id % 50 <> 7").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    paths = F.array(F.col("l_partkey") % 40, F.col("l_suppkey") % 60, F.col("l_partkey") % 80, F.lit(3).cast("long"))
    items = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block_id"), F.col("l_linenumber").alias("position")).agg(F.min("l_returnflag").alias("config"), F.min(paths).alias("paths"))
    found = items.select("block_id", "position", "config").join(keyed.resolved(items, ["block_id", "position"], "paths", images), ["block_id", "position"])
    identity = F.concat(F.lit('{"config": "'), "config", F.lit('", "image_sha": ["'), F.array_join("digests", '", "'), F.lit('"]}'))
    unknown = F.array_join(F.col("unknown").cast("array<string>"), ",")
    return found.select("block_id", "position", unknown.alias("unknown"), F.when(unknown == "", F.sha2(identity, 256)).alias("key"))


@query("complete_queries", "SELECT l_orderkey AS block_id FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5))")
def complete_queries(spark, sf_dir):
    items = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), F.col("l_partkey").alias("part_id"))
    scored = A.read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("part_id"))
    return keyed.complete_groups(items, scored, "block_id", "part_id")


@query("todo_anti", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def todo_anti(spark, sf_dir):
    return keyed.to_do(A.read(spark, sf_dir, "documents"), A.read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("cached_semi", "SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def cached_semi(spark, sf_dir):
    return keyed.already(A.read(spark, sf_dir, "documents").select("doc_id", "lang"), A.read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("dedupe_first", A.SQL + "SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1")
def dedupe_first(spark, sf_dir):
    return keyed.first_per_key(A.log(spark, sf_dir), ["key"], ["ord"])


@query("conflicts", A.SQL + "SELECT key, count(*) AS n_rows, count(DISTINCT config) AS n_kinds FROM log GROUP BY key HAVING count(DISTINCT config) > 1")
def conflicts(spark, sf_dir):
    return keyed.conflicts(A.log(spark, sf_dir), ["key"], ["config"])


@query("upsert", A.SQL + "SELECT key, config, ord FROM log WHERE config NOT IN ('src1', 'src2') UNION ALL SELECT key, config, -ord FROM log WHERE config IN ('src1', 'src2')")
def upsert(spark, sf_dir):
    old = A.log(spark, sf_dir).select("key", "config", "ord")
    return keyed.upsert(old, old.where(F.col("config").isin("src1", "src2")).withColumn("ord", -F.col("ord")), "config")


@query("set_intersect", "SELECT doc_id FROM documents WHERE n_chars > 2000 INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").where("n_chars > 2000").select("doc_id").intersect(A.read(spark, sf_dir, "labels").select("doc_id"))


@query("shared_candidate", "SELECT l_partkey AS part_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)")
def shared_candidate(spark, sf_dir):
    """Candidates that every regime has."""
    items = A.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_id"), F.concat("l_returnflag", "l_linestatus").alias("regime"))
    regimes = items.agg(F.count_distinct("regime").alias("all"))
    return items.groupBy("part_id").agg(F.count_distinct("regime").alias("n")).join(F.broadcast(regimes), F.col("n") == F.col("all")).select("part_id")


@query("systematic_sample", "SELECT p_partkey AS part_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r % 17 = 1")
def systematic_sample(spark, sf_dir):
    """Every 17th of each group, beginning with the first."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return A.read(spark, sf_dir, "part").withColumn("r", rank).where("r % 17 = 1").select(F.col("p_partkey").alias("part_id"))


@query("role_lookup", A.SQL + "SELECT peg_id, label AS role, arg_max(offset_mm, offset_mm) AS cand_id FROM ladder GROUP BY ALL")
def role_lookup(spark, sf_dir):
    """The last candidate of each role."""
    return A.ladder(spark, sf_dir).groupBy("peg_id", F.col("label").alias("role")).agg(F.max_by("offset_mm", "offset_mm").alias("cand_id"))


@query("paired_wins", A.SQL + """SELECT split, count(*) AS pairs, count(*) FILTER (mate > other) AS wins FROM (SELECT split, block_id, max(p_yes) FILTER (label = 'compatible') AS mate, arg_min(p_yes, position) FILTER (label = 'incompatible') AS other FROM lab GROUP BY ALL)
WHERE mate IS NOT NULL AND other IS NOT NULL GROUP BY split""")
def paired_wins(spark, sf_dir):
    """How often the mate beats the first distractor of its block."""
    mate, other = F.col("label") == "compatible", F.when(F.col("label") == "incompatible", F.col("position"))
    pairs = A.labelled(spark, sf_dir).groupBy("split", "block_id").agg(F.max(F.when(mate, F.col("p_yes"))).alias("mate"), F.min_by("p_yes", other).alias("other"))
    return pairs.where("mate is not null and other is not null").groupBy("split").agg(F.count("*").alias("pairs"), F.count_if(F.col("mate") > F.col("other")).alias("wins"))


@query("own_rank", A.SQL + "SELECT block_id, r AS rank FROM (SELECT block_id, label, row_number() OVER (PARTITION BY block_id ORDER BY p_yes DESC, cand_id) AS r FROM lab) WHERE label = 'compatible'")
def own_rank(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("p_yes"), "cand_id"))
    return A.labelled(spark, sf_dir).withColumn("rank", rank.cast("long")).where("label = 'compatible'").select("block_id", "rank")


@query("replica_report", A.SQL + """, r AS (SELECT split, label, row_number() OVER (PARTITION BY block_id ORDER BY p_yes DESC, cand_id) AS a, row_number() OVER (PARTITION BY block_id ORDER BY answer <> 'yes', CASE WHEN answer = 'yes' THEN -top_prob ELSE top_prob END, cand_id) AS b FROM lab WHERE has_mate)
SELECT split, count(*) AS n, count(*) FILTER (a = 1) AS top1_score, count(*) FILTER (b = 1) AS top1_answer, round(avg(a), 9) AS mean_rank FROM r WHERE label = 'compatible' GROUP BY split""")
def replica_report(spark, sf_dir):
    """The own item's place in two orders."""
    from ..operators.decide import composite_order

    w = Window.partitionBy("block_id")
    rows = A.labelled(spark, sf_dir).withColumns({"a": F.row_number().over(w.orderBy(F.desc("p_yes"), "cand_id")), "b": F.row_number().over(w.orderBy(*composite_order()))}).where("label = 'compatible'")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("a") == 1).alias("top1_score"), F.count_if(F.col("b") == 1).alias("top1_answer"), F.round(F.avg("a"), 9).alias("mean_rank"))


@query("block_verify", A.SQL + "SELECT block_id, sum((label = 'compatible' OR block_id % 13 = 5 AND position = 1)::INT)::BIGINT AS mates, has_mate FROM lab GROUP BY ALL HAVING (sum((label = 'compatible' OR block_id % 13 = 5 AND position = 1)::INT) = 1) <> has_mate")
def block_verify(spark, sf_dir):
    """Blocks without exactly one mate where there should be one, or with one where not, when some first candidates are mislabelled."""
    altered = F.when((F.col("block_id") % 13 == 5) & (F.col("position") == 1), "compatible").otherwise(F.col("label"))
    n = A.labelled(spark, sf_dir).withColumn("label", altered).groupBy("block_id", "has_mate").agg(F.count_if(F.col("label") == "compatible").alias("mates"))
    return n.where((F.col("mates") == 1) != F.col("has_mate")).select("block_id", "mates", "has_mate")


_REPLAY = "".join(f" UNION ALL SELECT method, '{k}' AS metric, count(*) FILTER ({a}) / nullif(count(*) FILTER ({b}), 0) AS v FROM a GROUP BY method" for k, a, b in (("coverage", "outcome IN ('correct', 'wrong')", "true"), ("accepted_risk", "outcome = 'wrong'", "outcome IN ('correct', 'wrong')"), ("correct_yield", "outcome = 'correct'", "present"))).removeprefix(" UNION ALL ")


@query("replay_compare", A.SQL + decisions.FAULT + decisions._UNION + f""", m AS ({_REPLAY}), s AS (SELECT *, round(v, 12) AS computed, round(CASE WHEN method = 'S2' AND metric = 'coverage' THEN v + 1e-6 ELSE v END, 12) AS stored FROM m)
SELECT method, metric, stored, computed, coalesce(abs(stored - computed) <= 1e-11, stored IS NULL AND computed IS NULL) AS same FROM s""")
def replay_compare(spark, sf_dir):
    """A stored table of metrics, rows weighing alike, against what the rules give now, in long form and to 1e-12; one stored value is
    off. The stored side counts decided rows, the other weighs cells."""
    names = ("coverage", "accepted_risk", "correct_yield")
    blocks = decisions.block_table(spark, sf_dir)
    rows = decide_all(blocks, decisions.TAU, decisions.DELTA, "has_compatible")
    picked = F.col("outcome").isin("correct", "wrong")
    share = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    stored = rows.groupBy("method").agg(share(picked, F.lit(True)).alias("coverage"), share(F.col("outcome") == "wrong", picked).alias("accepted_risk"), share(F.col("outcome") == "correct", F.col("has_compatible")).alias("correct_yield"))
    stored = stored.withColumn("coverage", F.col("coverage") + F.when(F.col("method") == "S2", 1e-6).otherwise(0.0))
    computed = evaluate.report(evaluate.all_methods(blocks, decisions.TAU, decisions.DELTA), "method", weighting="query", digits=15)
    long = lambda df, v: df.unpivot("method", [*names], "metric", v)
    both = long(stored, "stored").join(long(computed, "computed"), ["method", "metric"], "full")
    same = F.coalesce(F.abs(F.col("stored") - F.col("computed")) <= 1e-11, F.col("stored").isNull() & F.col("computed").isNull())
    return both.select("method", "metric", F.round("stored", 12).alias("stored"), F.round("computed", 12).alias("computed"), same.alias("same"))


@query("missing_partners", "SELECT count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey)) AS n_pairs FROM lineitem WHERE l_partkey % 7 = 3")
def missing_partners(spark, sf_dir):
    """How many rows of a join find no partner, and how many distinct pairs they are."""
    items = A.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("peg"), F.col("l_suppkey").alias("socket"))
    known = items.where("peg % 7 <> 3").distinct()
    return keyed.without_partner(items, known, "peg", "socket")


@query("set_difference", A.SQL + "SELECT family, bool_or(split = 'calib') AND NOT bool_or(split = 'test' AND tier = 'hard') AS only_calib, count(DISTINCT tier) = 2 AS has_all FROM qry GROUP BY family")
def set_difference(spark, sf_dir):
    """Families of one set that another lacks, and those that hold all members of a third."""
    rows = A.blocks(spark, sf_dir)
    per = rows.groupBy("family").agg(F.collect_set("split").alias("splits"), F.collect_set("tier").alias("tiers"), F.bool_or((F.col("split") == "test") & (F.col("tier") == "hard")).alias("hard"))
    every = F.array(F.lit("easy"), F.lit("hard"))
    return per.select("family", (F.array_contains("splits", "calib") & ~F.col("hard")).alias("only_calib"), (F.size(F.array_except(every, "tiers")) == 0).alias("has_all"))


@query("first_by_id", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def first_by_id(spark, sf_dir):
    """The first twenty rows by id."""
    return A.read(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(20)


@query("order_by_position", A.SQL + "SELECT block_id, string_agg(answer, ' ' ORDER BY position) AS answers FROM cand GROUP BY block_id")
def order_by_position(spark, sf_dir):
    """Answers of a block in the order of their positions, which are read as text and compared as numbers."""
    rows = A.candidates(spark, sf_dir).select("block_id", F.col("position").cast("string").alias("position"), "answer")
    inner = F.array_sort(F.collect_list(F.struct(F.col("position").cast("int").alias("p"), "answer")))
    return rows.groupBy("block_id").agg(F.array_join(F.transform(inner, lambda x: x["answer"]), " ").alias("answers"))


@query("rounded_sink", A.SQL + "SELECT part_id, (part_id // 2 + CASE WHEN part_id % 4 = 3 THEN 1 ELSE 0 END)::DOUBLE AS half FROM shapes")
def rounded_sink(spark, sf_dir):
    """Halves rounded to even, as at sinks."""
    return A.shapes(spark, sf_dir).select("part_id", F.bround(F.col("part_id") / 2, 0).alias("half"))


@query("text_pieces", "SELECT page_id, regexp_replace(url, '&ref=x$', '') AS url, len(string_split(url, '/')) AS parts FROM pages")
def text_pieces(spark, sf_dir):
    """A suffix taken off where it stands, and a count of parts."""
    return A.read(spark, sf_dir, "pages").select("page_id", scores.without_suffix(F.col("url"), "&ref=x").alias("url"), F.size(F.split("url", "/")).cast("long").alias("parts"))


@query("list_literal", "SELECT doc_id, lang AS first, 3::BIGINT AS n FROM documents")
def list_literal(spark, sf_dir):
    """A list that was written as Python writes it, read back."""
    said = F.concat(F.lit("['"), F.col("lang"), F.lit("', 'it\\'s', 'b\"c']"))
    return A.read(spark, sf_dir, "documents").select("doc_id", scores.list_literal(said).alias("x")).select("doc_id", F.get("x", F.lit(0)).alias("first"), F.size("x").cast("long").alias("n"))


@query("iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM events")
def iso_time(spark, sf_dir):
    """Timestamps as ISO 8601 text, in UTC, to the second."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp_ntz"))
    return A.read(spark, sf_dir, "events").select("event_id", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("at"))


@query("prompt_render", "SELECT item_id, 'USER: <image> Does ' || replace(text, chr(10), ' ') || ' fit? ASSISTANT:' AS prompt FROM benchmark")
def prompt_render(spark, sf_dir):
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    return A.read(spark, sf_dir, "benchmark").select("item_id", F.format_string("USER: <image> Does %s fit? ASSISTANT:", text).alias("prompt"))
