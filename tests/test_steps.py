"""Steps of tracks, numbered by order, against plain Python on tables with repeats and nulls."""

import contextlib
import datetime
import io

import duckdb
from pyspark.sql import functions as F

from sequent.operators import metrics
from sequent.plans import adapters


def written(tmp_path):
    """Small tables: an order stands twice, a line and a part twice, some keys and types are null, one line has no supplier."""
    con, day = duckdb.connect(), datetime.date(2020, 1, 1)
    orders = [(k, k % 5, day + datetime.timedelta(days=k * 7 % 11)) for k in range(60)] + [(3, 3, day), (60, None, day), (61, 1, day)]
    parts = [(k, [*adapters.CLASSES, "ÄNDERE", None][k % 8]) for k in range(40)] + [(7, "LARGE")]
    lines = [(k % 61, n % 3 + k % 7, k * 13 % 41, None if k == 17 else k * 5 % 9) for k in range(400) for n in range(1 + k % 3)]
    for name, columns, rows in (("orders", "o_orderkey, o_custkey, o_orderdate", orders), ("part", "p_partkey, p_type", parts), ("lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", lines)):
        kinds = {"orders": "BIGINT, BIGINT, TIMESTAMP", "part": "BIGINT, VARCHAR", "lineitem": "BIGINT, INTEGER, BIGINT, BIGINT"}[name].split(", ")
        con.execute(f"create table {name} ({', '.join(f'{c} {k}' for c, k in zip(columns.split(', '), kinds, strict=True))})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(kinds))})", rows)
        extra = ", DATE '2020-01-01' AS l_shipdate, 1.0 AS l_extendedprice" if name == "lineitem" else ""
        con.execute(f"copy (select *{extra} from {name}) to '{tmp_path}/{name}.parquet' (format parquet)")
    return orders, parts, lines


def test_steps_equal_numbered_lines(spark, tmp_path):
    orders, parts, lines = written(tmp_path)
    tracks = {}
    for okey, _, part, supplier in lines:
        for key, game, date in orders:
            for p, kind in parts:
                if key == okey and p == part:
                    side = "white" if supplier is not None and supplier % 2 == 0 else "black"
                    tracks.setdefault((game, side), []).append((date, okey, kind))
    want = [(game, side, step, okey, max((k for *_, k in track if k is not None), default=None)) for (game, side), track in tracks.items() for step, (_, okey, _) in enumerate(sorted(track, key=lambda x: x[:2]), 1)]
    got = [tuple(r) for r in adapters.steps(spark, str(tmp_path)).select("game", "side", "step", "okey", "truth").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_what_is_sorted_is_a_row_an_order(spark, tmp_path):
    """Not the lines: they are no more than counted, and columns that only break ties are not read."""
    written(tmp_path)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        adapters.distributions(spark, str(tmp_path), "AB").select("game", F.size("o").alias("n")).explain()
    above = plan.getvalue().split("Exchange hashpartitioning(game")
    assert len(above) == 2 and "Aggregate(key=[l_orderkey" in above[1] and "Aggregate" not in above[0]
    assert not any(c in plan.getvalue() for c in ("l_extendedprice", "l_shipdate", "l_linenumber"))


def test_mask_sums_of_arrays_need_no_exchange_by_row(spark):
    cells = [[(True, 0.9), (False, 0.2)], [(True, 0.4), (False, 0.7), (True, 0.5)], [(True, 0.0)], []]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, cells array<struct<y:boolean,q:double>>")
    long = rows.select("k", F.explode("cells").alias("c")).select("k", "c.*")
    got = metrics.mask_array_sums(rows, "cells", "y", "q")
    assert got.collect() == metrics.mask_sums(long, ["k"], "y", "q").select(*got.columns).collect()
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        got.explain()
    assert "hashpartitioning" not in plan.getvalue()
