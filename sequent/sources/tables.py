"""Tables that jobs pass on, and places in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.sources.folders import fresh_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_numbered(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Rows with `part` (their place in a range partitioning by keys) and `local` (their place in the part).

    Stored, so that both stay what they are however often the rows are read.
    """
    ids = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", ids)
    placed = placed.withColumn("part", F.shiftright("__id", 33)).withColumn("local", F.col("__id") - F.shiftleft(F.shiftright("__id", 33), 33))
    return stored(placed.drop("__id"), name)


def part_offsets(df: DataFrame, total, by: str = "part") -> DataFrame:
    """For each part the sum of `total` over all parts before it: a running sum over one row per part."""
    sums = df.groupBy(by).agg(total.cast("long").alias("__sum"))
    before = W.Window.orderBy(by).rowsBetween(W.Window.unboundedPreceding, -1)
    return sums.select(by, F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias("before"))


def numbered(df: DataFrame, keys: list, into: str) -> DataFrame:
    """Rows with their place from 0 in the order of keys, by a range sort: no task sees more than its part."""
    columns = df.columns
    held = range_numbered(df, keys, "numbered")
    return held.join(part_offsets(held, F.count("*")), "part").select(*columns, (F.col("before") + F.col("local")).alias(into))
