"""Strict lines, physical order, committed files, hash trees, nested values and digests of histories against plain Python."""

import hashlib
import io
import json

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequent.functions import nested
from sequent.operators import identify, sequences, trees
from sequent.sources import committing, lines, ndjson


def plain_lines(data, most):
    """(offset, bytes, text, fault) of every line, straight from the definition."""
    out, at = [], 0
    for part in data.split(b"\n")[:-1] + ([data.split(b"\n")[-1]] if data and not data.endswith(b"\n") else []):
        ended = at + len(part) < len(data)
        text, fault = None, None
        if len(part) > most:
            fault = lines.OVERLONG
        else:
            try:
                text = part.decode()
                fault = lines.UNENDED if not ended else lines.RETURN if text.endswith("\r") else lines.BLANK if not text else None
            except UnicodeDecodeError:
                fault = lines.NOT_UTF8
        out.append((at, len(part), text, fault))
        at += len(part) + 1
    return out


def odd_file(rng, n):
    parts = [b"", b"plain", "Straße   \x85".encode(), b"\xff\xfe", b"cr\r", b"\r", b"x" * 40, b"y" * 41, b"z" * 500, b"a\rb"]
    return b"\n".join(rng.choice(parts) for _ in range(n)) + rng.choice([b"", b"\n"])


def test_lines_of_ranges_are_the_lines_of_the_file():
    rng = random.Random(3)
    for _ in range(300):
        data = odd_file(rng, rng.randint(0, 30))
        size, chunk = rng.randint(1, 200), rng.randint(1, 64)
        got = [(offset, n, *lines.judged(content, ended)) for start in range(0, len(data), size) for offset, n, content, ended in lines.lines_between(io.BytesIO(data), start, min(len(data), start + size), 40, chunk)]
        assert got == plain_lines(data, 40), (data, size, chunk)


def test_strict_source_reads_files_and_numbers_lines(spark, tmp_path):
    rng = random.Random(5)
    (tmp_path / "in/deep").mkdir(parents=True)
    files = {name: odd_file(rng, n) for name, n in (("a.txt", 400), ("deep/b.txt", 57), ("empty", 0), ("one", 1))} | {"_hidden": b"no\n", ".crc": b"no\n"}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = lines.read_lines(spark, f"file://{tmp_path}/in", 40, 97)
    assert got.rdd.getNumPartitions() > 20
    rows = lines.numbered_lines(got, got).collect()
    for name, data in files.items():
        own = sorted((r.line, r.offset, r.bytes, r.value, r.fault) for r in rows if r.file.endswith(f"/in/{name}"))
        assert own == ([] if name[0] in "_." else [(k, *x) for k, x in enumerate(plain_lines(data, 40), 1)]), name


def test_strict_rows_and_rejects_of_files(spark, tmp_path):
    good = [{"id": k, "name": f"n{k}"} for k in range(50)]
    text = [json.dumps(x).encode() for x in good]
    bad = {7: (b'{"id":1,"id":2,"name":"x"}', "repeated key or bad number"), 9: (b'{"id":1,"name":"\xc3("}', "not UTF-8"), 12: (b'{"id":1}', "keys differ"), 20: (b"", "blank line"), 31: (text[31] + b"\r", "carriage return"), 40: (b'{"id":1,"name":"' + b"x" * 300 + b'"}', "over-long"), 44: (b'{"id":"a","name":"x"}', "bad value"), 45: (b'{"id":NaN,"name":"x"}', "not an object"), 49: (text[49], "no line feed at the end")}
    (tmp_path / "x.jsonl").write_bytes(b"\n".join(bad[k][0] if k in bad else line for k, line in enumerate(text)))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    rows, rejects = ndjson.strict_files(spark, f"{tmp_path}/x.jsonl", schema, 100, 64)
    assert sorted(r.id for r in rows.collect()) == [k for k in range(50) if k not in bad]
    assert sorted((r.line, r.reason) for r in rejects.collect()) == [(k + 1, reason) for k, (_, reason) in sorted(bad.items())]


def test_file_order_across_part_borders(spark, tmp_path):
    rng = random.Random(9)
    games = [g for g in rng.choices(range(12), k=60) for _ in range(rng.randint(1, 9))]
    (tmp_path / "order").write_text("".join(f"{g}\n" for g in games))
    rows = lines.read_lines(spark, f"{tmp_path}/order", part_bytes=11).withColumn("g", F.col("value").cast("int"))
    found, breaks = lines.file_order(rows, "g", "g")
    heads = [k for k in range(len(games)) if not k or games[k] != games[k - 1]]
    assert {r.g: (r.runs, r.rows) for r in found.collect()} == {g: (sum(games[k] == g for k in heads), games.count(g)) for g in set(games)}
    offsets = [0]
    for g in games:
        offsets.append(offsets[-1] + len(f"{g}\n"))
    assert sorted((r.g, r.after, r.offset) for r in breaks.collect()) == sorted((games[k], games[k - 1], offsets[k]) for k in heads if k and games[k] < games[k - 1])


def test_committed_files_and_their_manifest(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("name")).repartition(7)
    path = f"file://{tmp_path}/out"
    manifest = {r.file: r for r in committing.write_lines(rows, path).collect()}
    files = os.listdir(tmp_path / "out/data")
    assert sorted(manifest) == sorted(files) and sorted(os.listdir(tmp_path)) == ["out"]
    for name, m in manifest.items():
        data = (tmp_path / "out/data" / name).read_bytes()
        assert (m.rows, m.bytes, m.sha256) == (data.count(b"\n"), len(data), hashlib.sha256(data).hexdigest())
    assert sorted(json.loads(x)["id"] for name in files for x in (tmp_path / "out/data" / name).read_text().splitlines()) == list(range(1000))
    with pytest.raises(Exception, match="already exists"):
        committing.write_lines(rows, path)
    assert len(os.listdir(tmp_path / "out/data")) == len(files)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    broken = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        committing.write_lines(broken, f"{tmp_path}/gone")
    assert os.listdir(tmp_path) == []


def test_what_killed_attempts_left_is_not_published(tmp_path):
    writer = committing.Writer(f"{tmp_path}/out")
    for name in ("part-0-1.jsonl", "part-0-2.jsonl", "part-1-3.jsonl"):
        with open(f"{writer._staging}/data/{name}", "w") as out:
            out.write("x\n" if name != "part-1-3.jsonl" else "")
    writer.commit([committing.Written("part-0-2.jsonl", 1, 2, "d"), committing.Written("part-1-3.jsonl", 0, 0, "e"), None])
    assert os.listdir(tmp_path / "out/data") == ["part-0-2.jsonl"] and json.loads((tmp_path / "out/manifest.json").read_text())["rows"] == 1
    with pytest.raises(FileExistsError):
        committing.Writer(f"{tmp_path}/out")
    late = committing.Writer(f"{tmp_path}/other")
    os.makedirs(tmp_path / "other")
    with pytest.raises(FileExistsError):
        late.commit([])
    assert sorted(os.listdir(tmp_path)) == ["other", "out"]


def test_files_are_hashed_as_streams(spark, tmp_path):
    rng = random.Random(1)
    data = {f"f{k}": rng.randbytes(rng.randint(0, 3000)) for k in range(20)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listed = spark.createDataFrame([(f"file://{tmp_path}/{name}", len(content)) for name, content in data.items()], "path string, length long")
    got = committing.hashed_files(listed, task_bytes=4000, chunk=100)
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in got.collect()} == {name: hashlib.sha256(content).hexdigest() for name, content in data.items()}
    assert committing.hashed_files(listed.limit(0)).count() == 0


def plain_root(rows, leaf, fan):
    level, nodes = 0, [hashlib.sha256(line.encode()).hexdigest() for _, line in sorted(rows, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()))]
    size = leaf
    while level == 0 or len(nodes) > 1:
        nodes = [hashlib.sha256((f"{level}:" + "".join(nodes[k : k + size])).encode()).hexdigest() for k in range(0, len(nodes), size)]
        level, size = level + 1, fan
    return nodes[0]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 300])
def test_hash_tree_root(spark, n):
    rows = [(k // 2, f"line {k}") for k in range(n)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v string")
    for parts in (1, 5):
        got = trees.root(df.repartition(parts), ["k"], F.col("v"), 8, 3).first()
        assert (got.digest, got.rows, got["first"].k, got["last"].k) == (plain_root(rows, 8, 3), n, 0, (n - 1) // 2)


def test_hash_tree_of_nothing_and_descent(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    assert trees.tree(df.limit(0), ["k"], F.col("v")).count() == 0
    other = df.withColumn("v", F.when(F.col("k").isin(3, 250, 499), "new").otherwise(F.col("v")))
    got = trees.changed(df, other.repartition(6), ["k"], F.col("v"), 8, 3)
    assert sorted((r.k, r.in_a, r.in_b) for r in got.collect()) == sorted((k, x, 1 - x) for k in (3, 250, 499) for x in (0, 1))
    assert trees.changed(df, df, ["k"], F.col("v"), 8, 3).count() == 0
    more = trees.changed(df.where("k <> 100"), df, ["k"], F.col("v"), 8, 3).collect()
    assert [(r.k, r.in_a, r.in_b) for r in more] == [(100, 0, 1)]


CANONICAL = [
    ('{"b": 1, "a": {"d": [1.0, -0.0, 0], "c": null}}', '{"a":{"c":null,"d":[1,0,0]},"b":1}'), ("[1e21, 1e20, 1.5e-7, 0.000001, 123456.789e3, -2.50]", "[1e+21,100000000000000000000,1.5e-7,0.000001,123456789,-2.5]"),
    ('{"\\ud83d\\ude00": 1, "\\uffff": 2, "z": true}', '{"z":true,"\U0001f600":1,"￿":2}'), ('"a\\u0041\\n"', '"aA\\n"'), ("9007199254740993", "9007199254740992"), ("NaN", None), ("[1e400]", None), ('{"a":1,"a":1}', None), ("{", None), (None, None), ("[" * 100_000, None),
]


def test_canonical_json(spark):
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CANONICAL)], "k int, text string")
    assert [r.c for r in df.select("k", nested.canonical_json("text").alias("c")).orderBy("k").collect()] == [want for _, want in CANONICAL]
    rng = random.Random(0)
    for _ in range(2000):
        x = rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-30, 30)
        assert float(nested.number_text(x)) == x and ("e" in nested.number_text(x)) == (abs(x) >= 1e21 or abs(x) < 1e-6)


def plain_leaves(value, path=""):
    if isinstance(value, dict) and value:
        return {p: v for k, x in value.items() for p, v in plain_leaves(x, path + "." + k.replace("\\", "\\\\").replace(".", "\\.").replace("[", "\\[")).items()}
    if isinstance(value, list) and value:
        return {p: v for k, x in enumerate(value) for p, v in plain_leaves(x, f"{path}[{k}]").items()}
    return {path: value}


def plain_status(a, b):
    numbers = [x for x in (a, b) if isinstance(x, (int, float)) and not isinstance(x, bool)]
    if len(numbers) == 2 and any(isinstance(x, float) for x in numbers):
        return "same" if abs(a - b) <= 1e-6 else "different"
    return "same" if type(a) is type(b) and a == b else "different"


def test_nested_reports_are_compared_leaf_by_leaf(spark):
    rng = random.Random(12)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice(["a", "b", "c.d", "e[0"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, 2, 1.5, 1.5000004, 1.6, True, False, None, "x", "", "1", 10**15, -0.25])

    def changed(x):
        if rng.random() < 0.1:
            return value(2)
        return {k: changed(v) for k, v in x.items()} if isinstance(x, dict) else [changed(v) for v in x] if isinstance(x, list) else x

    pairs = [(k, x, changed(x)) for k in range(60) for x in [value(6)]]
    a, b = (spark.createDataFrame([(p[0], json.dumps(p[n])) for p in pairs], "k int, report string") for n in (1, 2))
    got = {(r.k, r.path): r.status for r in nested.compared(a, b, ["k"], "report").collect()}
    want = {}
    for k, x, y in pairs:
        left, right = plain_leaves(x), plain_leaves(y)
        want |= {(k, p): "only in a" if p not in right else "only in b" if p not in left else plain_status(left[p], right[p]) for p in left | right}
    assert got == want
    odd = spark.createDataFrame([(1, "{"), (2, None), (3, "[]")], "k int, report string")
    assert sorted((r.k, r.kind) for r in nested.flattened(odd, ["k"], "report").collect()) == [(1, "broken"), (3, "array")]


def test_carried_histories(spark):
    moves = [("g", k, m) for k, m in enumerate("abcabca", 1)] + [("h", 1, "a")]
    rows = [(g, k, m, [x[2] for x in moves if x[0] == g and x[1] < k]) for g, k, m in moves]
    bad = {("g", 3): ["b", "a"], ("g", 5): ["a", "b", "c"], ("h", 1): ["a"]}
    rows = [(g, k, m, bad.get((g, k), past)) for g, k, m, past in rows]
    df = spark.createDataFrame(rows, "g string, k int, m string, past_moves array<string>")
    assert {(r.g, r.k) for r in sequences.history_breaks(df, ["g"], "k", "m", "past_moves").collect()} == set(bad)


def test_longitudinal_faults(spark):
    moves = spark.createDataFrame([("g", k, m) for k, m in enumerate("abcde", 1)], "g string, k int, m string")
    rows = sequences.with_past(moves, ["g"], "k", "m", 1).withColumns({"t": F.when(F.col("k") == 2, "other").otherwise("t"), "h": F.when(F.col("k") == 5, "h2").otherwise("h1"), "mask": F.when(F.col("k") == 3, 6).when(F.col("k") > 3, 4).otherwise(2), "past": F.col("past") + (F.col("k") == 4).cast("int")})
    found = identify.longitudinal(rows, ["g"], "k", (), "t", sequences.move_digest("k", "m", 1), "past", "h", "mask")
    assert {r.k: r.faults for r in found.collect()} == {2: ["truth"], 4: ["history", "restored"], 5: ["history", "hypotheses"]}

