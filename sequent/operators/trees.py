"""Hash trees: a digest of any number of rows that no partitioning changes, and that finds what differs between two tables.

Rows are numbered in the order of their keys by a range sort.  A leaf digests `leaf` rows that follow each other, a node
`fan` nodes of the level below, until one is left.  So no task holds more than `leaf` digests or `fan` nodes of a group,
and every level is an aggregate over a table that is shorter by that factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequent.sources.tables import numbered, stored


def _folded(rows: DataFrame, level: int, size: int) -> DataFrame:
    """Rows (node, digest, rows, first, last) folded by `size` neighbours; the level stands in what is digested."""
    parts = F.array_sort(F.collect_list(F.struct("node", "digest")))
    digest = F.sha2(F.concat(F.lit(f"{level}:"), F.array_join(F.transform(parts, lambda x: x["digest"]), "")), 256)
    found = rows.groupBy(F.floor(F.col("node") / size).alias("node")).agg(digest.alias("digest"), F.sum("rows").alias("rows"), F.min_by("first", "node").alias("first"), F.max_by("last", "node").alias("last"))
    return found.withColumn("level", F.lit(level))


def leaves_of(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(node, digest, rows, first, last) of single rows in the order of keys; repeats of a key stand in the order of their digests."""
    each = rows.select(*keys, F.sha2(line, 256).alias("digest"))
    first = F.struct(*keys)
    return numbered(each, [*keys, "digest"], "node").select("node", "digest", F.lit(1).cast("long").alias("rows"), first.alias("first"), first.alias("last"))


def tree(rows: DataFrame, keys: list[str], line: Column, leaf: int = 1_024, fan: int = 1_024) -> DataFrame:
    """level, node, digest, rows, first, last: all levels, 0 being the leaves; the highest has one node.  No rows: no nodes."""
    own = stored(_folded(leaves_of(rows, keys, line), 0, leaf), "tree-0")
    levels, level = own, 0
    while own.count() > 1:
        level += 1
        own = stored(_folded(own, level, fan), f"tree-{level}")
        levels = levels.unionByName(own)
    return levels


def root(rows: DataFrame, keys: list[str], line: Column, leaf: int = 1_024, fan: int = 1_024) -> DataFrame:
    """digest, rows, first, last of all rows."""
    levels = tree(rows, keys, line, leaf, fan)
    return levels.join(levels.agg(F.max("level").alias("level")), "level").select("digest", "rows", "first", "last")


def changed(a: DataFrame, b: DataFrame, keys: list[str], line: Column, leaf: int = 1_024, fan: int = 1_024) -> DataFrame:
    """keys, in_a, in_b of rows that only one table has, found by descent: below a node that both trees have alike nothing is looked at.

    Nodes hold rows by number, so a row that is put in or taken out moves all behind it; a row that is changed moves none.
    """
    left, right = tree(a, keys, line, leaf, fan), tree(b, keys, line, leaf, fan)
    top = max(x.agg(F.max("level")).first()[0] or 0 for x in (left, right))
    suspects = None
    for level in range(top, -1, -1):
        x, y = (t.where(F.col("level") == level).select("node", "digest") for t in (left, right))
        if suspects is not None:
            x, y = (t.join(suspects, F.floor(F.col("node") / fan) == F.col("parent"), "left_semi") for t in (x, y))
        both = x.join(y.withColumnRenamed("digest", "other"), "node", "full_outer")
        suspects = stored(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select(F.col("node").alias("parent")), "suspects")
    x, y = (leaves_of(t, keys, line).join(suspects, F.floor(F.col("node") / leaf) == F.col("parent"), "left_semi").groupBy("first", "digest").agg(F.count("*").alias("n")) for t in (a, b))
    both = x.withColumnRenamed("n", "in_a").join(y.withColumnRenamed("n", "in_b"), ["first", "digest"], "full_outer").fillna(0, ["in_a", "in_b"])
    return both.where("in_a <> in_b").select("first.*", "in_a", "in_b")
