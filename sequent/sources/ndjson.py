"""Strict and lenient row sources, and sinks that never overwrite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequent.operators.trees import root
from sequent.sources.committing import hashed_files
from sequent.sources.lines import numbered_lines, read_lines


def repeated_keys(raw: Column) -> Column:
    """Whether a JSON object names a top-level key twice."""
    keys = F.json_object_keys(raw)
    return F.size(keys) != F.size(F.array_distinct(keys))


def nested_repeats(rows: DataFrame, raw: str) -> DataFrame:
    """Adds `repeats`: whether any object in the JSON text, at any depth, names a key twice; also true of broken text."""
    import json

    def pairs(found: list) -> dict:
        if len({k for k, _ in found}) != len(found):
            raise ValueError("repeated key")
        return dict(found)

    def refuse(name: str):
        raise ValueError(name)

    def bad(text: str) -> bool:
        try:
            json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
        except (ValueError, TypeError):
            return True
        return False

    # A flat object of plain strings and numbers is judged in the JVM; only what may nest is sent to Python.
    plain = F.col(raw).rlike(r"^\s*\{[^{}\[\]']*\}\s*$") & ~F.col(raw).rlike("NaN|Infinity")
    judged = F.pandas_udf(lambda texts: texts.map(lambda x: None if x is None else bad(x)), T.BooleanType())
    return rows.withColumn("repeats", F.when(plain, F.coalesce(repeated_keys(F.col(raw)), F.lit(False))).otherwise(judged(F.when(~plain, F.col(raw)))))


def strict(lines: DataFrame, schema: T.StructType, raw: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of one JSON object per line: closed key set, no blank line, no repeated key, no NaN or Infinity.

    rejects has the line's columns and the reason; a `fault` that the source found comes first.  Types follow the
    schema; a value of another type is a reason too.
    """
    expected = F.array_sort(F.array(*(F.lit(f.name) for f in schema.fields)))
    keys = F.array_sort(F.array_distinct(F.json_object_keys(raw)))
    parsed = nested_repeats(lines, raw).withColumn("__row", F.from_json(raw, T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowNonNumericNumbers": "false"}))
    found = F.col("fault") if "fault" in lines.columns else F.lit(None).cast("string")
    reason = (
        F.when(F.trim(raw) == "", "blank line").when(F.json_object_keys(raw).isNull(), "not an object").when(F.col("repeats"), "repeated key or bad number")
        .when(keys != expected, "keys differ").when(F.col("__row._broken").isNotNull(), "bad value")
    )
    marked = parsed.withColumn("reason", F.coalesce(found, reason))
    return marked.where("reason is null").select(*(F.col(f"__row.{f.name}").alias(f.name) for f in schema.fields)), marked.where("reason is not null").select(*lines.columns, "reason")


def strict_files(spark: SparkSession, path: str, schema: T.StructType, most: int = 64 << 20, part_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the JSON lines in the files under a path; rejects: file, line (its number), offset, bytes, reason."""
    lines = read_lines(spark, path, most, part_bytes)
    rows, rejects = strict(lines, schema)
    return rows, numbered_lines(lines, rejects).select("file", "line", "offset", "bytes", "reason")


def lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; blank lines and unknown keys are skipped."""
    return spark.read.schema(schema).json(path)


def exploded(traces: DataFrame, keys: list[str], steps: str, public: list[str]) -> DataFrame:
    """Nested traces to step rows, with the named public fields only."""
    return traces.select(*keys, F.posexplode(steps).alias("ply", "__s")).select(*keys, "ply", *(F.col(f"__s.{c}").alias(c) for c in public))


def catalog(entries: DataFrame, key: str, family: str) -> tuple[DataFrame, DataFrame]:
    """(one row per id, ids with conflicting families)."""
    found = entries.groupBy(key).agg(F.count_distinct(family).alias("families"), F.first(family).alias(family))
    return found.where("families = 1").drop("families"), found.where("families > 1").select(key, "families")


def corpus(items: DataFrame, text: str, declared: str, key: str) -> DataFrame:
    """Adds `ok`: the content's SHA-256 is the declared one, and no other item has the same content."""
    own = items.withColumn("__h", F.sha2(text, 256))
    again = own.groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1")
    return own.join(again, "__h", "left").withColumn("ok", (F.col("__h") == F.col(declared)) & F.col("__n").isNull()).drop("__h", "__n")


def one_label_each(items: DataFrame, labels: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, status of every item and label: `ok` if an item has exactly one label, else missing, unknown or repeated."""
    own = items.groupBy(key).agg(F.count("*").alias("__items"))
    found = labels.groupBy(key).agg(F.count("*").alias("__labels"), F.min(value).alias(value))
    both = own.join(found, key, "full_outer")
    status = F.when(F.col("__items").isNull(), "unknown").when(F.col("__labels").isNull(), "missing").when((F.col("__items") > 1) | (F.col("__labels") > 1), "repeated").otherwise("ok")
    return both.select(key, F.when(status == "ok", F.col(value)).alias(value), status.alias("status"))


def namespaced(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Ordered union of sources; ids get their source's name in front."""
    for name in sources:
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a safe namespace: {name!r}")
    parts = [df.withColumn(key, F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))).withColumn("namespace", F.lit(name)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def manifest(rows: DataFrame, game: str, keys: list[str], identity: str) -> DataFrame:
    """games, rows, bytes, sha256 of rows as JSON lines (root of a hash tree in the order of keys), and the identity if all rows have one."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    same = F.when((F.min(identity) == F.max(identity)) & (F.count(identity) == F.count("*")), F.min(identity)).alias("identity")
    counts = rows.agg(F.count_distinct(game).alias("games"), F.sum(F.octet_length(line) + 1).alias("bytes"), same)
    return counts.join(root(rows, keys, line).select("rows", F.col("digest").alias("sha256")))  # one row each


def sidecar_faults(rows: DataFrame) -> Column:
    """Why a calibration row (side, logits, truth, mask) cannot be used; null if it can.

    Logits and mask must have one length and finite values, the truth must be one of their places and not masked.
    """
    n, finite = F.size("logits"), F.forall("logits", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(F.col("logits").isNull() | F.col("mask").isNull() | F.col("truth").isNull() | F.col("side").isNull(), "missing field").when((n == 0) | (n != F.size("mask")), "lengths differ")
        .when(~finite, "logit not finite").when((F.col("truth") < 0) | (F.col("truth") >= n), "truth out of range").when(F.coalesce(F.get("mask", F.col("truth").cast("int")), F.lit(True)), "truth is masked")
    )


def write_sidecar(rows: DataFrame, path: str) -> None:
    """Calibration rows by side, where nothing is yet."""
    rows.select("side", "logits", "truth", "mask").write.mode("errorifexists").partitionBy("side").parquet(path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Calibration rows; one that cannot be used fails the read."""
    rows = spark.read.parquet(path)
    fault = sidecar_faults(rows)
    checked = F.when(fault.isNull(), F.col("truth")).otherwise(F.raise_error(F.concat(F.lit("sidecar: "), fault)).cast(rows.schema["truth"].dataType))
    return rows.withColumn("truth", checked)


def write_report(report: DataFrame, path: str) -> None:
    """Rows as JSON lines with sorted keys, where nothing is yet."""
    report.select(F.to_json(F.struct(*sorted(report.columns))).alias("value")).write.mode("errorifexists").text(path)


def inventory(spark: SparkSession, path: str, game: Column) -> DataFrame:
    """Per file under a root: folder, bytes, lines, games and the content's SHA-256; then one row (folder null) for all of them, with the union of games.

    Contents are hashed as streams; the listing reads none.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), game.alias("game"))
    counts = lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_distinct("game").alias("games"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("path"), "length")
    files = hashed_files(listed).select(F.col("path").alias("file"), F.col("length").alias("bytes"), "sha256")
    folder = F.element_at(F.split("file", "/"), -2)
    each = files.join(counts, "file", "left").select(folder.alias("folder"), "bytes", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("games", F.lit(0)).alias("games"), "sha256")
    union = lines.agg(F.count("*").alias("lines"), F.count_distinct("game").alias("games"))
    total = listed.agg(F.sum("length").alias("bytes")).crossJoin(union)  # one row each
    return each.unionByName(total.select(F.lit(None).cast("string").alias("folder"), "bytes", "lines", "games", F.lit(None).cast("string").alias("sha256")))
