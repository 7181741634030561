"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequent.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node it reaches.

    Every step keeps at most as many edges as there were; the number of steps grows with the logarithm of the
    longest chain.  A node that very many edges share is one key of a join; its lowest neighbour comes from a stored
    table, so that both sides of the join are plain shuffles and Spark splits the key's rows over tasks.  Edges from a
    node to itself connect nothing.  No edges: no rows.
    """
    held = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = held.union(held.select("v", "u"))
        lowest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "stars")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        held = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(held.select("v", "v").distinct())
