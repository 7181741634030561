"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequent.sources.folders import fresh_path
from sequent.sources.tables import part_offsets, range_numbered, stored

__all__ = ["WORD", "fresh_path", "part_offsets", "range_numbered", "sent_whole", "stored"]

#: One word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def sent_whole(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A stored table, marked for broadcast if its rows written as JSON have `most` bytes at most, arrays and all.

    Beyond that a join shuffles, and Spark splits hot keys.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df
