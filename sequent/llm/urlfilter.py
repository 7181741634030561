"""URL rules by a sort-merge range join.

A rule (host, path) becomes the key reversed-host/path, and a url becomes one probe per suffix of its host: suffix
reversed, then its path.  A rule fits a probe if its key is a prefix of the probe's, that is if the probe lies in the
interval that starts at the rule's key.  Rules and probes are range-sorted together; a sweep carries the last rule
before each place, and with it the stack of rules whose intervals are open there (the rule and those it lies in).
The innermost rule of the stack that still holds the probe is the longest that fits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.llm.shared import stored

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to /, ?, # or the end, A-Z lowered; empty without `://` or if null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without `://` or if null."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def rule_key(host: Column, path: Column) -> Column:
    """A host holds no slash, so its reversed labels, a slash and the path sort by host, then path."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/"), path)


def open_rules(rules: DataFrame) -> DataFrame:
    """rules with `stack`: the keys, rules and verdicts of a rule and of the rules it lies in, innermost first."""
    lengths = F.sequence(F.lit(1), F.length("key"))
    outer = rules.select(F.col("key").alias("inner"), F.explode(F.transform(lengths, lambda n: F.substring("key", F.lit(1), n))).alias("key"))
    nested = outer.join(rules.select("key", "rule", "verdict"), "key")
    stack = F.sort_array(F.collect_list(F.struct(F.length("key").alias("size"), "key", "rule", "verdict")), asc=False)
    return nested.groupBy("inner").agg(stack.alias("stack")).withColumnRenamed("inner", "key")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) that a rule fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    suffix = F.explode(suffixes).alias("suffix")
    probes = urls.select("host", "path", suffix).select("host", "path", "suffix", rule_key(F.col("suffix"), F.col("path")).alias("key"))
    starts = open_rules(rules).select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("suffix"), "stack")
    swept = starts.unionByName(probes.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    swept = stored(swept.repartitionByRange("key", "kind", "host", "path").withColumn("part", F.spark_partition_id()), "url-sweep")
    order = W.Window.partitionBy("part").orderBy("key", "kind").rowsBetween(W.Window.unboundedPreceding, 0)
    last = swept.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    carried = swept.select("part").distinct().join(last, "part", "left")  # a row a part
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = carried.select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    found = swept.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1").join(carried, "part")
    inner = F.filter(F.coalesce("stack", "carried"), lambda r: F.startswith(F.col("key"), r["key"]))
    found = found.select("host", "path", F.length("suffix").alias("size"), F.get(inner, F.lit(0)).alias("r")).where("r is not null")
    longest = F.max(F.struct("size", F.col("r.size").alias("key_size"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")))
    return found.groupBy("host", "path").agg(longest.alias("m")).select("host", "path", "m.rule", "m.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """For each row of `pages`: page_id, host, path, rule, verdict.

    rules (verdict, rule): rule is host and path as one string, `net/` being host net and path /.  A rule fits its
    host and all subdomains, if the url's path starts with the rule's.  The longest wins: the one of the longest
    host, then of the longest path; of rules that are the same, the one with the greatest verdict.  A url that no
    rule fits has a null rule and the default verdict, as have a null url and one without `://`: both have an
    empty host and path.  A rule that is null or has an empty host fits nothing.  Without rules, or without pages,
    the same holds.  Other columns are not read.
    """
    rule_host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), UPPER, LOWER)
    rule_path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    keyed = rules.select("rule", "verdict", rule_host.alias("h"), rule_path.alias("p")).where("h <> ''")
    keyed = keyed.select(rule_key(F.col("h"), F.col("p")).alias("key"), "rule", "verdict").groupBy("key").agg(F.max(F.struct("verdict", "rule")).alias("m")).select("key", "m.rule", "m.verdict")
    own = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fits = matched(own.where("host <> ''").select("host", "path").distinct(), keyed)
    return own.join(fits, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
