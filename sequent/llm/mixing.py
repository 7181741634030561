"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents stand in a seeded order on a line of words that is cut into blocks of `block` words.  The
mix has a number of blocks to give; they go to sources by the highest quotients target / (2 seats - 1), and each
source's blocks go to its shards (runs of `shard_blocks` blocks) by the same rule, which gives every shard an
integer quota.  In a shard every block is taken quota // blocks times, and a run of quota % blocks blocks, from a
seeded place on (round the shard's end), once more.  As the order on the line is seeded, that run is a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.llm import words
from sequent.llm.shared import WORD, part_offsets, range_numbered, stored


def word_count(text: Column) -> Column:
    """Words of a text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple, share: float, limit: float) -> DataFrame:
    """Add number, weight and target to (source, source_size).

    Weights repeat over the sources in code point order, null last.  The mix holds share x all words.  A target
    that would pass limit x its source's size stops there, and what is left goes to the others by weight: sources
    fill up in the order of limit x size / weight.
    """
    by_name = W.Window.orderBy(F.asc_nulls_last("source"))
    numbered = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    numbered = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    numbered = numbered.withColumn("before", F.coalesce(F.sum("source_size").over(by_name.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    full = F.col("source_size") * F.lit(limit)
    every = W.Window.partitionBy()
    filling = W.Window.orderBy(full / F.col("weight"), "number")
    whole = F.sum("source_size").over(every) * F.lit(share)
    left = whole - F.coalesce(F.sum(full).over(filling.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(0, W.Window.unboundedFollowing))
    found = numbered.withColumn("level", left / rest)
    found = found.withColumn("stopped", full <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("stopped"), F.struct("number_filling", "level"))).over(every)["level"]
    found = found.withColumn("number_filling", F.row_number().over(filling)).withColumn("level", level)
    return found.withColumn("target", F.when(F.col("stopped"), full).otherwise(F.col("weight") * F.col("level"))).drop("level", "stopped", "number_filling")


def apportioned(parties: DataFrame, group: list[str], party: str, share: str, most: str, seats: str) -> DataFrame:
    """Add `quota`: the group's seats given to parties by the highest quotients share / (2 k - 1), k up to `most`.

    Seats at a divisor of all shares / seats are near the outcome; only the quotients around them are ranked.  So
    `most` may only bind in rounding: it must not be under share x seats / all shares.
    """
    own = W.Window.partitionBy(*group)
    ideal = F.col(share) * F.col(seats) / F.sum(share).over(own)
    found = parties.withColumn("__ideal", F.coalesce(F.when(F.sum(share).over(own) > 0, ideal), F.lit(0.0)))
    near = F.least(F.col(most), F.floor(F.col("__ideal") + 0.5))
    reach = F.ceil(F.col("__ideal") * F.count("*").over(own) / F.greatest(F.col(seats), F.lit(1))) + 2
    found = found.withColumn("__base", F.greatest(F.lit(0), near - reach).cast("long")).withColumn("__top", F.least(F.col(most), near + reach).cast("long"))
    found = found.withColumn("__free", F.col(seats) - F.sum("__base").over(own))
    options = found.where((F.col("__top") > F.col("__base")) & (F.col(share) > 0)).select(*group, party, share, "__free", F.explode(F.sequence(F.col("__base") + 1, "__top")).alias("__k"))
    ranked = options.withColumn("__rank", F.row_number().over(W.Window.partitionBy(*group).orderBy(F.desc(F.col(share) / (2 * F.col("__k") - 1)), party)))
    won = ranked.where(F.col("__rank") <= F.col("__free")).groupBy(*group, party).agg(F.count("*").alias("__won"))
    found = found.join(won, [*group, party], "left")
    return found.withColumn("quota", F.col("__base") + F.coalesce("__won", F.lit(0))).drop("__ideal", "__base", "__top", "__free", "__won")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, limit: int = 2, block: int = 64, shard_blocks: int = 16_384, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each document of `docs` (doc_id, text, source).

    Returns, for each row of docs: doc_id, source, size (words), source_size, target (of its source, words), taken
    (words, repeats counted), cuts (array of from, to, times: the word ranges taken).  No document is taken more
    than `limit` times.  A null or empty text has no words, and nothing of it is taken.  Null sources are one
    source.  Rows alike in doc_id, source and size may change places, which changes nothing in the result.  Columns
    named in `carry` follow, as they are in the row; others are not read.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    carried = [F.col(c).alias(f"__carry_{k}") for k, c in enumerate(carry)]
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("order"), *carried)
    held = range_numbered(sized, [F.asc_nulls_last("source"), "order", F.asc_nulls_first("doc_id"), "size"], "mix-lines")
    lines = held.select("doc_id", "source", "size", "part", "local")
    sources = targets(lines.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("most", F.col("blocks") * limit).withColumn("all", F.lit(0))
    sources = sources.withColumn("seats", F.floor(F.sum("target").over(W.Window.partitionBy("all")) / block + 0.5))
    sources = stored(apportioned(sources, ["all"], "number", "target", "most", "seats").drop("all", "most", "seats"), "mix-sources")

    shards = sources.where("blocks > 0").select("number", "quota", "blocks", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / shard_blocks))).alias("shard"))
    shards = shards.withColumn("own", F.least(F.lit(shard_blocks), F.col("blocks") - F.col("shard") * shard_blocks)).withColumn("most", F.col("own") * limit).withColumnRenamed("quota", "seats")
    shards = apportioned(shards, ["number"], "shard", "own", "most", "seats")
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("number").cast("string"), F.col("shard").cast("string")))
    shards = shards.select("number", "shard", F.floor(F.col("quota") / F.col("own")).alias("times"), (F.col("quota") % F.col("own")).alias("extra"), (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % F.col("own")).alias("first"), "own")

    in_part = W.Window.partitionBy("part").orderBy("local").rowsBetween(W.Window.unboundedPreceding, -1)
    before = part_offsets(lines, F.sum("size")).withColumnRenamed("before", "part_before")
    placed = lines.withColumn("in_part", F.coalesce(F.sum("size").over(in_part), F.lit(0))).join(before, "part")
    head = sources.select(F.col("source").alias("__source"), "number", "source_size", "target", "before")
    placed = placed.join(head, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = placed.withColumn("start", F.col("part_before") + F.col("in_part") - F.col("before")).drop("part_before", "in_part", "before")

    width = block * shard_blocks
    last = F.greatest(F.col("start"), F.col("start") + F.col("size") - 1)
    spread = placed.where("size > 0").select("part", "local", "number", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))).alias("shard")).join(shards, ["number", "shard"])
    edge = F.col("shard") * width

    def taken(first: Column, past: Column, times: Column) -> Column:
        """The document's own word range within a run of the shard's blocks."""
        low = F.greatest(F.col("start"), edge + first * block)
        high = F.least(F.col("start") + F.col("size"), edge + past * block)
        return F.struct((low - F.col("start")).alias("from"), (high - F.col("start")).alias("to"), times.cast("int").alias("times"))

    over = F.greatest(F.lit(0), F.col("first") + F.col("extra") - F.col("own"))
    runs = F.array(taken(F.lit(0), F.col("own"), F.col("times")), taken(F.col("first"), F.least(F.col("own"), F.col("first") + F.col("extra")), F.lit(1)), taken(F.lit(0), over, F.lit(1)))
    spread = spread.select("part", "local", F.filter(runs, lambda r: (r["to"] > r["from"]) & (r["times"] > 0)).alias("cuts"))
    cuts = spread.groupBy("part", "local").agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("cuts"))
    words_taken = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, r: a + (r["to"] - r["from"]) * r["times"])
    found = placed.join(cuts, ["part", "local"], "left")
    if carry:
        found = found.join(held.select("part", "local", *(f"__carry_{k}" for k in range(len(carry)))), ["part", "local"])
    empty = F.array().cast("array<struct<from:bigint,to:bigint,times:int>>")
    more = [F.col(f"__carry_{k}").alias(c) for k, c in enumerate(carry)]
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce(words_taken, F.lit(0)).alias("taken"), F.coalesce("cuts", empty).alias("cuts"), *more)


def cut_texts(docs: DataFrame, text: str = "text", cuts: str = "cuts") -> DataFrame:
    """One row for each time a word range is taken: `text` cut to the range, white space inside kept; `cuts` goes.

    Ranges of a document that follow each other and are taken in the same round are one row; a document that is
    taken whole keeps its text as it is.
    """
    kept = [c for c in docs.columns if c != cuts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, ranges = batch[names.index(text)].to_pylist(), batch[names.index(cuts)].to_pylist()
            rows, made = [], []
            for k, (own, found) in enumerate(zip(texts, ranges, strict=True)):
                if not found:
                    continue
                data = np.frombuffer((own or "").encode(), np.uint8)
                starts, ends = words.spans(data)
                for n in range(max(sum(r["times"] for r in found), 0)):
                    joined = []
                    for a, b in rounds_of(found, n):
                        if joined and joined[-1][1] == a:
                            joined[-1][1] = b
                        else:
                            joined.append([a, b])
                    for a, b in joined:
                        rows.append(k)
                        made.append(own if (a, b) == (0, len(starts)) else data[starts[a] : ends[b - 1]].tobytes().decode())
            out = batch.take(pa.array(rows, pa.int32()))
            columns = [pa.array(made, pa.string()) if name == text else out[name] for name in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != cuts)
    return docs.mapInArrow(cut, schema)


def rounds_of(found: list[dict], n: int) -> list[tuple[int, int]]:
    """The ranges that are taken in round n: each place of a document is taken in as many rounds as it has times."""
    edges = sorted({e for r in found for e in (r["from"], r["to"])})
    deep = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if sum(r["times"] for r in found if r["from"] <= a and b <= r["to"]) > n]
    return deep
