"""Nested JSON values: one canonical form, and comparison path by path at any depth."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequent.sources.tables import stored


def number_text(x: int | float) -> str:
    """A number in its shortest decimal form: plain from 1e-6 up to 1e21, with an exponent beyond; -0 is 0."""
    if isinstance(x, int) and abs(x) <= 1 << 53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent  # places before the decimal point
    if 0 < point <= 21:
        text = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        text = f"0.{'0' * -point}{text}"
    else:
        text = f"{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + text


def canonical(value) -> str:
    """Compact JSON with keys sorted at every depth (by UTF-16 units) and numbers in one form."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number_text(value)
    return json.dumps(value, ensure_ascii=False)


def _pairs(found: list) -> dict:
    if len(dict(found)) != len(found):
        raise ValueError("repeated key")
    return dict(found)


def _refuse(name: str):
    raise ValueError(name)


def canonical_text(text: str | None) -> str | None:
    """The canonical form of a JSON text; None for one that is broken, repeats a key or holds a non-finite number."""
    if text is None:
        return None
    try:
        return canonical(json.loads(text, object_pairs_hook=_pairs, parse_constant=_refuse))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """canonical_text of every row."""
    return texts.map(canonical_text)


def flattened(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, path, kind, value for every leaf of the JSON texts; a container without members is a leaf.

    Level by level over VARIANT until nothing nests, so at any depth; a level is a table of its own.  A text that is no JSON
    has one leaf of the kind "broken".  path: members as .name (dots in names escaped), items as [n].
    """
    parsed = rows.select(*keys, F.lit("").alias("path"), F.expr(f"try_parse_json(`{text}`)").alias("v"), F.col(text).isNull().alias("__none"))
    broken = parsed.where(F.col("v").isNull() & ~F.col("__none")).select(*keys, "path", F.lit("broken").alias("kind"), F.lit(None).cast("string").alias("value"))
    level, found = parsed.where("v is not null").drop("__none"), broken
    while True:
        kind = F.schema_of_variant("v")
        level = stored(level.withColumn("kind", kind), "nested")
        nests = (F.col("kind").startswith("OBJECT<") & (F.col("kind") != "OBJECT<>")) | (F.col("kind").startswith("ARRAY<") & (F.variant_get("v", "$[0]", "variant").isNotNull()))
        held = F.coalesce(nests, F.lit(False))
        simple = F.when(F.col("kind").startswith("OBJECT"), "object").when(F.col("kind").startswith("ARRAY"), "array").when(F.col("kind").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").when(F.col("kind") == "BIGINT", "int").otherwise(F.lower("kind"))
        found = found.unionByName(level.where(~held).select(*keys, "path", simple.alias("kind"), F.to_json("v").alias("value")))
        inner = level.where(held)
        if inner.isEmpty():
            return found
        spark = rows.sparkSession
        member = inner.select(*keys, "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*keys, "path", "pos", "key", "value")
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.regexp_replace("key", r"([.\[\\])", r"\\$1"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = member.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("v"))


def compared(a: DataFrame, b: DataFrame, keys: list[str], text: str, tolerance: float = 1e-6) -> DataFrame:
    """keys, path, status of every leaf of two tables of JSON texts, and the difference of numbers.

    Numbers of which one is a float agree within the tolerance; all else agrees if kind and value do.  status: same,
    different, only in a, only in b.
    """
    left, right = (flattened(x, keys, text).select(*keys, "path", F.struct("kind", "value").alias(name)) for x, name in ((a, "a"), (b, "b")))
    both = left.join(right, [*keys, "path"], "full_outer")
    numbers = F.col("a.kind").isin("int", "float") & F.col("b.kind").isin("int", "float") & ((F.col("a.kind") == "float") | (F.col("b.kind") == "float"))
    gap = F.when(numbers, F.abs(F.col("a.value").cast("double") - F.col("b.value").cast("double")))
    same = F.when(numbers, gap <= tolerance).otherwise((F.col("a.kind") == F.col("b.kind")) & F.col("a.value").eqNullSafe(F.col("b.value")))
    status = F.when(F.col("b").isNull(), "only in a").when(F.col("a").isNull(), "only in b").when(same, "same").otherwise("different")
    return both.select(*keys, "path", status.alias("status"), gap.alias("difference"))


def evidence_difference(a: DataFrame, b: DataFrame, keys: list[str], text: str, tolerance: float = 1e-6) -> DataFrame:
    """keys, unmatched, different, floats (compared as such), max_difference: a row for each report that has a leaf."""
    found = compared(a, b, keys, text, tolerance)
    return found.groupBy(*keys).agg(F.count_if(F.col("status").startswith("only")).alias("unmatched"), F.count_if(F.col("status") == "different").alias("different"), F.count("difference").alias("floats"), F.max("difference").alias("max_difference"))
