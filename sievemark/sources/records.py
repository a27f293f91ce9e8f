"""Readers and writers with the checks that logs and records need."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "key string, answer string, p_yes double, config string, _bad string"
METHOD_FIELDS = {"S1": ("tau",), "S2": ("tau", "delta")}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; an empty cell is null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue="", mode="FAILFAST")


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """CSV with a header, nulls empty, nested columns as JSON with sorted keys; refuses to overwrite. digits: columns that are
    rounded (halves to even) as they are written."""
    nested = {c: canonical_json(F.col(c), df.schema[c].dataType) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    df.withColumns(nested | {c: F.bround(c, n) for c, n in (digits or {}).items()}).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON text with the keys of structs and maps in order."""
    return F.to_json(_ordered(value, kind))


def _ordered(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(_ordered(value[f.name], f.dataType).alias(f.name) for f in fields)))
    return value


def ragged_union(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows with all columns in order of first appearance."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """Rows of all files of a JSON-lines log; see parsed_log()."""
    found = spark.read.option("lineSep", "\n").text(path)
    return parsed_log(found.select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("size")), schema)


def unfinished(line: Column) -> Column:
    """Whether a line begins an object and opens more braces, outside of strings, than it closes."""
    bare = F.regexp_replace(line, r'"(\\.|[^"\\])*("|\\?$)', "")
    return F.startswith(F.ltrim(line), F.lit("{")) & (F.regexp_count(bare, F.lit(r"\{")) > F.regexp_count(bare, F.lit(r"\}")))


def parsed_log(lines: DataFrame, schema: str = LOG) -> DataFrame:
    """Rows of JSON lines (value, or value, source and size in bytes of the file that each line is from).

    Of each file only the last line may be torn, as a writer that was stopped leaves it: no newline ends it, and it begins an
    object that it doesn't finish; it is left out. (Lines without source are one file, and nothing ends its last line.) Any other
    broken line, a finished last one included, a line without key, and rows of one key that differ stop the job. Equal repeats
    of a key count once."""
    if "source" not in lines.columns:
        lines = lines.select("value", F.lit("").alias("source"), F.lit(None).cast("long").alias("size"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    ends = lines.groupBy("source").agg(F.max("at").alias("last"), F.sum(F.octet_length("value") + 1).alias("ended"), F.first("size").alias("size"))
    ends = ends.select("source", "last", F.coalesce(F.col("ended") > F.col("size"), F.lit(True)).alias("open"))
    rows = lines.where(F.trim("value") != "").join(ends, "source").select(
        "value", (F.col("open") & (F.col("at") == F.col("last")) & unfinished(F.col("value"))).alias("torn"),
        F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r"),
    )
    rows = rows.where("not torn or r._bad is null")
    broken = F.col("r._bad").isNotNull() | F.col("r.key").isNull()
    rows = rows.withColumn("key", F.when(broken, F.raise_error(F.concat(F.lit("broken log line: "), F.substring("value", 1, 80))).cast("string")).otherwise(F.col("r.key")))
    return _one_per_key(rows.select("key", *[F.col(f"r.{c}").alias(c) for c in rows.select("r.*").columns if c not in ("key", "_bad")]))


def _one_per_key(rows: DataFrame) -> DataFrame:
    """rows, equal ones once; rows of one key that differ stop the job."""
    rest = F.struct(*[c for c in rows.columns if c != "key"])
    once = rows.groupBy("key").agg(F.first(rest).alias("r"), F.count_distinct(F.to_json(rest, {"ignoreNullFields": "false"})).alias("kinds"))
    sure = F.when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("conflicting rows for "), F.col("key"))).cast("string")).otherwise(F.col("key"))
    return once.select(sure.alias("key"), "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_log(rows: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Adds rows with new keys; keys that are there already (in existing, or else in the log at path) stay as they are. New
    rows of one key that differ stop the job. A broken tail of an older file stays what it is: new rows get files of their own."""
    if existing is None and exists(rows.sparkSession, path):
        existing = read_log(rows.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _bad string")
    new = rows if existing is None else rows.join(existing.select("key"), "key", "left_anti")
    new = _one_per_key(new).select(*rows.columns)
    new.select(canonical_json(F.struct(*new.columns), T.StructType(list(new.schema))).alias("value")).write.mode("append").text(path)


def read_record(path: str) -> dict:
    """A JSON object; anything else is an error."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"unreadable record {path}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return found


def write_record(path: str, record: dict) -> None:
    """JSON with sorted keys, once: an existing file stays and NaN is refused."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(record, f, indent=1, sort_keys=True, allow_nan=False)


def locked_versions(path: str) -> dict[str, list[str]]:
    """Versions of each package in a TOML lock file."""
    import tomllib

    out: dict[str, list[str]] = {}
    for p in tomllib.loads(Path(path).read_text(encoding="utf-8")).get("package", []):
        out.setdefault(p["name"], []).append(p.get("version", ""))
    return out


def _unit(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and 0 <= x <= 1


def record_faults(record: dict) -> list[str]:
    """What is wrong with a calibration record."""
    faults = [f"{k} is missing" for k in ("split", "n", "counts", "thresholds") if k not in record]
    if faults:
        return faults
    if record["split"] != "calib":
        faults.append("not fitted on the calibration split")
    counts = record["counts"]
    if not counts or any(isinstance(v, bool) or not isinstance(v, int) or v <= 0 for v in counts.values()):
        faults.append("counts are not positive integers")
    elif sum(counts.values()) != record["n"]:
        faults.append("counts do not sum to n")
    for method, values in record["thresholds"].items():
        faults += [f"{method}.{k} is not in [0, 1]" for k in METHOD_FIELDS.get(method, ()) if not _unit(values.get(k))]
    return faults


def arm_faults(record: dict, expected: dict) -> list[str]:
    """What is wrong with the record of a run: every setting must be there and be what is expected, and no other may be."""
    faults = [f"{k} is missing" for k in sorted(expected.keys() - record.keys())] + [f"{k} is unknown" for k in sorted(record.keys() - expected.keys())]
    return faults + [f"{k} differs" for k in sorted(expected.keys() & record.keys()) if record[k] != expected[k]]


def test_pass_faults(record: dict, thresholds: dict, inputs: dict[str, str]) -> list[str]:
    """What is wrong with the record of a pass over the test split: its thresholds must be the frozen ones, its count of blocks
    positive, and its inputs' digests those of the files now."""
    faults = [f"{k} is missing" for k in ("split", "n", "thresholds", "inputs") if k not in record]
    if faults:
        return faults
    if record["split"] != "test":
        faults.append("not of the test split")
    if isinstance(record["n"], bool) or not isinstance(record["n"], int) or record["n"] <= 0:
        faults.append("n is not a positive integer")
    if record["thresholds"] != thresholds:
        faults.append("thresholds differ from the frozen ones")
    return faults + changed_inputs(record["inputs"], inputs)


def digests(paths: list[str]) -> dict[str, str]:
    """SHA-256 of each file's bytes."""
    out = {}
    for p in paths:
        with open(p, "rb") as f:
            out[p] = hashlib.file_digest(f, "sha256").hexdigest()
    return out


def changed_inputs(before: dict[str, str], after: dict[str, str]) -> list[str]:
    """Files that came, went or changed between two digests()."""
    return [f"{p} {'appeared' if p not in before else 'is gone' if p not in after else 'changed'}" for p in sorted(before.keys() | after.keys()) if before.get(p) != after.get(p)]


def version_of(package: str) -> str | None:
    """The installed version of a package, if there is one."""
    from importlib import metadata

    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of some places that exists, for a source that may have been written in one of them."""
    return next((p for p in paths if exists(spark, p)), None)


def guard_split(split: str, allowed: bool, record: dict | None) -> None:
    """The test split is read only with leave and a valid record."""
    if split == "test" and (not allowed or record is None or record_faults(record)):
        raise PermissionError("the test split needs leave and a frozen, valid record")
