"""A bigram language model by deleted interpolation, learned and applied over all documents.

P(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the frequency bucket of the context h
(the binary length of c(h)).  A part of the training documents is deleted from the counts, and expectation-
maximisation on it finds the mixture weights of each bucket; then all training documents count.

Words are 64-bit hashes.  Documents are laid in batches, and a batch asks once for each word and each word pair it
holds: requests are sorted key runs, dealt by key range, with the batch's own counts.  A key range adds up what all
askers bring and answers each with the totals of its keys, in 64 bits.  So a frequent word or pair costs one entry a
batch, and a key range gets about `range_keys` entries from all batches together, at any size of the corpus.

An asker deals its keys to `fan` ranges at most, so that the rows it makes stay bounded in number and do not shrink to
a few keys as the corpus grows.  Where more ranges are needed, the askers of a coarse range form teams of about `fan`,
a team adds up what its members bring and asks the finer ranges in their place, and hands the answers on: a tree of
exchanges whose depth grows with the logarithm of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequent.llm import words
from sequent.llm.shared import stored

#: Hashes that stand for the end of a text and for the place before its first word.
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
KEPT, DELETED, HELD_OUT = 0, 1, 2
#: Steps of log2 in which the probabilities of deleted tokens are counted.
FINE = 8
_NONE = -(1 << 30)


def squeezed(values: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    import zstandard

    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return words.mixed(h * np.uint64(0x9E3779B97F4A7C15) + w, 7)


BATCH = "batch long, deleted boolean, doc_ids array<long>, roles binary, lengths binary, words binary, places binary, tokens long, distinct long, train_tokens long, kept_tokens long"


def batched(docs: DataFrame, batch_chars: int) -> DataFrame:
    """Documents (doc_id, role, text) as batches of word places; deleted documents have batches of their own."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def row(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            ids, roles, texts = zip(*held[deleted], strict=True)
            hashes, counts = words.word_hashes(list(texts), lower=True)
            distinct, places = np.unique(hashes, return_inverse=True)
            counts, roles = counts.astype("<u4"), np.array(roles, np.uint8)
            kept, train = (int((counts[m] + 1).sum()) for m in (roles == KEPT, roles != HELD_OUT))
            held[deleted], size[deleted], made = [], 0, made + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((first + made, pa.int64()), (deleted, pa.bool_()), (list(ids), pa.list_(pa.int64())), (roles.tobytes(), pa.binary()), (squeezed(counts), pa.binary()), (squeezed(distinct), pa.binary()), (squeezed(places.astype("<u4")), pa.binary()), (len(hashes) + len(ids), pa.int64()), (len(distinct) + 2, pa.int64()), (train, pa.int64()), (kept, pa.int64()))],
                names=[c.split()[0] for c in BATCH.split(", ")],
            )

        for batch in batches:
            for doc_id, role, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "role", "text")), strict=True):
                deleted = role == DELETED
                if held[deleted] and size[deleted] + len(text or "") > batch_chars:
                    yield row(deleted)
                held[deleted].append((doc_id, role, text))
                size[deleted] += len(text or "")
        for deleted in (False, True):
            if held[deleted]:
                yield row(deleted)

    return docs.select("doc_id", "role", "text").mapInArrow(lay, BATCH)


class Batch:
    """The tokens of a batch: each token's place among the batch's distinct words, its context's, and the keys to ask for."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.roles = np.frombuffer(row["roles"], np.uint8)
        lengths = expanded(row["lengths"], "<u4").astype(np.int64)
        own = expanded(row["words"], "<u8")
        self.words = np.concatenate([own, [END, BEGIN]])
        self.sizes = lengths + 1
        stops = np.cumsum(self.sizes)
        self.word = np.full(int(stops[-1]), len(own), np.int64)  # the end's place
        inner = np.ones(len(self.word), bool)
        inner[stops - 1] = False
        self.word[inner] = expanded(row["places"], "<u4")
        self.context = np.concatenate([[0], self.word[:-1]])
        self.context[stops - self.sizes] = len(own) + 1
        self.pairs, self.pair = np.unique(pair_keys(self.words[self.context], self.words[self.word]), return_inverse=True)
        self.singles = np.sort(self.words)
        self.single = np.searchsorted(self.singles, self.words)
        self.role = np.repeat(self.roles, self.sizes)

    def counts(self, role: int) -> tuple[np.ndarray, np.ndarray]:
        """How often a role's tokens have each single and each pair."""
        mine = self.role == role
        single = np.bincount(self.single[self.word[mine]], minlength=len(self.singles))
        single[self.single[-1]] += int((self.roles == role).sum())  # texts begun
        return single, np.bincount(self.pair[mine], minlength=len(self.pairs))


REQUEST = "kind long, part long, asker long, n long, keys binary, kept binary, deleted binary"
#: Counts travel as 64-bit numbers; their upper byte planes are zeros and compress to nothing.
COUNT = "<u8"


def ranges(keys: np.ndarray, parts: int, first: int = 0, number: int | None = None) -> np.ndarray:
    """Where each of `number` ranges from `first` on, of `parts` equal ranges of 64-bit keys, ends in sorted keys that lie in them."""
    edges = np.array([(k << 64) // parts for k in range(first + 1, first + (number or parts))], np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def request_rows(kind: int, asker: int, keys: np.ndarray, counts: list[np.ndarray], parts: int, first: int = 0, number: int | None = None) -> Iterator[pa.RecordBatch]:
    """An asker's sorted keys and counts, a row for each range that has some."""
    start, made = 0, []
    for part, stop in enumerate(ranges(keys, parts, first, number).tolist(), first):
        if stop > start:
            own = keys[start:stop]
            made.append((kind, part, asker, len(own), squeezed(np.diff(own, prepend=np.uint64(0))), *(squeezed(c[start:stop].astype(COUNT)) for c in counts)))
        start = stop
    for at in range(0, len(made), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made[at : at + 64], strict=True)], names=[c.split()[0] for c in REQUEST.split(", ")])


def requested(batches: DataFrame, parts: tuple[int, int]) -> DataFrame:
    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                b = Batch(row)
                counts = [b.counts(role) for role in (KEPT, DELETED)]
                for kind, keys in ((0, b.singles), (1, b.pairs)):
                    yield from request_rows(kind, row["batch"], keys, [c[kind] for c in counts], parts[kind])

    return batches.mapInArrow(ask, REQUEST)


def summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, each row's keys' places among them end to end, their kept and deleted counts) of request rows."""
    distinct, which = np.unique(np.concatenate([np.cumsum(expanded(r["keys"], "<u8"), dtype=np.uint64) for r in rows]), return_inverse=True)
    # Sums of doubles are exact up to 2^53 occurrences of a key.
    return distinct, which, [np.bincount(which, np.concatenate([expanded(r[c], COUNT) for r in rows]), len(distinct)).astype(COUNT) for c in ("kept", "deleted")]


def answer_rows(rows: list[dict], which: np.ndarray, totals: list[np.ndarray], new_kept: int, new_train: int) -> pa.Table:
    """Totals for each request row; what is new is told once."""
    stops = np.cumsum([r["n"] for r in rows])
    parts = [which[stop - r["n"] : stop] for stop, r in zip(stops.tolist(), rows, strict=True)]
    return pa.table({
        **{c: pa.array([r[c] for r in rows], pa.int64()) for c in ("kind", "part", "asker")}, **{c: pa.array([squeezed(totals[k][p]) for p in parts], pa.binary()) for k, c in enumerate(("kept", "deleted"))},
        "new_kept": pa.array([new_kept] + [0] * (len(rows) - 1), pa.int64()), "new_train": pa.array([new_train] + [0] * (len(rows) - 1), pa.int64()),
    })


def add_up(table: pa.Table) -> pa.Table:
    """Totals of a key range, answered to each asker; new: distinct keys with a training count."""
    rows = table.to_pylist()
    _, which, totals = summed(rows)
    return answer_rows(rows, which, totals, int((totals[0] > 0).sum()), int((totals[0] + totals[1] > 0).sum()))


ANSWER = "kind long, part long, asker long, kept binary, deleted binary, new_kept long, new_train long"


def exchanged(requests: DataFrame, parts: tuple[int, int], askers: int, levels: int, fan: int) -> DataFrame:
    """Answers to stored requests that are dealt to `parts` ranges of either kind, `levels` finer levels being below."""
    if not levels:
        return requests.repartition(sum(parts), "kind", "part").groupBy("kind", "part").applyInArrow(add_up, ANSWER)
    teams, keys = -(-askers // fan), ["kind", "part", "team"]
    finer = tuple(n * fan for n in parts)
    number = min(16_384, sum(parts) * teams)
    teamed = requests.withColumn("team", F.pmod(F.xxhash64("asker"), F.lit(teams)))

    def gather(table: pa.Table) -> pa.Table:
        kind, part, team = (table[c][0].as_py() for c in keys)
        distinct, _, totals = summed(table.to_pylist())
        return pa.Table.from_batches(list(request_rows(kind, team, distinct, totals, finer[kind], part * fan, fan)))

    def hand_on(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, found = left.to_pylist(), sorted(right.to_pylist(), key=lambda r: r["finer"])
        _, which, _ = summed(rows)
        totals = [np.concatenate([expanded(r[c], COUNT) for r in found]) for c in ("kept", "deleted")]
        return answer_rows(rows, which, totals, sum(r["new_kept"] for r in found), sum(r["new_train"] for r in found))

    asked = stored(teamed.repartition(number, *keys).groupBy(*keys).applyInArrow(gather, REQUEST), "lm-teams")
    found = exchanged(asked, finer, teams, levels - 1, fan).withColumnRenamed("part", "finer")
    found = found.withColumn("part", F.floor(F.col("finer") / fan)).withColumnRenamed("asker", "team")
    left, right = (x.repartition(number, *keys).groupBy(*keys) for x in (teamed, found))
    return left.cogroup(right).applyInArrow(hand_on, ANSWER)


def answers_to(batches: DataFrame, wanted: tuple[int, int], number: int, fan: int) -> DataFrame:
    """Totals for every batch, `wanted` key ranges of either kind being enough."""
    levels, first = 0, wanted
    while max(first) > fan:
        levels, first = levels + 1, tuple(-(-n // fan) for n in first)
    requests = requested(batches, first)
    return exchanged(stored(requests, "lm-requests") if levels else requests, first, max(1, number), levels, fan)


def answered(b: Batch, answers: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(kept, deleted) totals of the batch's singles and pairs."""
    rows = sorted(answers.select(["kind", "part", "kept", "deleted"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
    out = []
    for kind, keys in ((0, b.singles), (1, b.pairs)):
        own = [tuple(expanded(r[c], COUNT) for c in ("kept", "deleted")) for r in rows if r["kind"] == kind]
        both = tuple(np.concatenate([o[k] for o in own]).astype(np.int64) for k in (0, 1))
        if len(both[0]) != len(keys):
            raise RuntimeError("a batch has not got the answers it asked for")
        out.append(both)
    return out


def bucket(count: np.ndarray) -> np.ndarray:
    """Binary length of a count: 0, 1, 2-3, 4-7, ..."""
    return np.frexp(count.astype(np.float64))[1]


def log_steps(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(FINE * np.log2(np.where(p > 0, p, 1))), _NONE).astype(np.int64)


def weights_by_em(rows: list[tuple[int, int, int, int]], uniform: float, rounds: int = 100) -> dict[int, tuple[float, float, float]]:
    """Mixture weights (pair, single, uniform) of each bucket from (bucket, pair step, single step, tokens)."""
    found = {}
    for b in sorted({r[0] for r in rows}):
        own = np.array([r[1:] for r in rows if r[0] == b], np.float64)
        p = np.stack([np.where(own[:, k] > _NONE, 2.0 ** (np.maximum(own[:, k], -2000) / FINE), 0) for k in (0, 1)] + [np.full(len(own), uniform)], 1)
        w = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(rounds):
            share = p * w
            share *= (own[:, 2] / share.sum(1))[:, None]
            after = share.sum(0) / own[:, 2].sum()
            if np.abs(after - w).max() < 1e-9:
                break
            w = after
        w = np.maximum(w, [0, 0, 1e-7])  # an unseen word never gets nothing
        found[b] = tuple((w / w.sum()).tolist())
    return found


def scores(docs: DataFrame, batch_chars: int = 6_000_000, range_keys: int = 1_500_000, fan: int = 1_024) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32(doc_id as text) mod 10 is not 0; of these, mod 1 are deleted while
    the weights are found.  A null doc_id is an empty text for that.  Tokens: words between ASCII white space with
    A-Z lowered, then one end; a null, empty or blank text is its end alone.  Rows that repeat a doc_id are
    documents of their own.  Without training documents every token has the uniform probability.  A very long text is
    a batch of its own, scored whole.  No rows: no rows.  Other columns are not read, whatever their names.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    role = F.when(fold == 0, HELD_OUT).when(fold == 1, DELETED).otherwise(KEPT)
    batches = stored(batched(docs.select("doc_id", "text", role.alias("role")), batch_chars), "lm-batches")
    total = batches.agg(F.count("*").alias("batches"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "train_tokens", "kept_tokens"))).first()
    parts = tuple(max(1, -(-total[c] // range_keys)) for c in ("distinct", "tokens"))
    answers = stored(answers_to(batches, parts, total["batches"], fan).withColumnRenamed("asker", "batch"), "lm-counts")
    distinct = answers.where("kind = 0").agg(F.coalesce(F.sum("new_kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("new_train"), F.lit(0)).alias("train")).first()
    n_kept, n_train = total["kept_tokens"], total["train_tokens"]
    v_kept, v_train = (max(0, distinct[c] - 1) for c in ("kept", "train"))  # the place before a text is no token

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        """How many deleted tokens have each bucket and each probability."""
        b = Batch(left.to_pylist()[0])
        (single, _), (pair, _) = answered(b, right)
        single = single[b.single]
        mine = b.role == DELETED
        before = single[b.context[mine]]
        steps = np.stack([bucket(before), log_steps(pair[b.pair[mine]] / np.maximum(before, 1)), log_steps(single[b.word[mine]] / max(n_kept, 1))])
        cells, n = np.unique(steps, axis=1, return_counts=True)
        return pa.table({"bucket": cells[0], "pair": cells[1], "single": cells[2], "tokens": n.astype(np.int64)})

    by_batch = answers.select("kind", "part", "batch", "kept", "deleted")
    deleted = batches.where("deleted")
    seen = deleted.groupBy("batch").cogroup(by_batch.join(deleted.select("batch"), "batch", "left_semi").groupBy("batch")).applyInArrow(look, "bucket long, pair long, single long, tokens long")
    cells = seen.groupBy("bucket", "pair", "single").agg(F.sum("tokens").alias("tokens")).collect()  # a bounded grid of logarithms
    found = weights_by_em([tuple(r) for r in cells], 1 / (v_kept + 1))
    top = 70
    table = np.zeros((top, 3))
    for k in range(top):  # a bucket without deleted tokens takes the weights of the nearest one that has some
        near = min((b for b in found if (b == 0) == (k == 0)), key=lambda b: (abs(b - k), b), default=None)
        table[k] = found[near] if near is not None else ((0.0, 0.5, 0.5) if k == 0 else (1 / 3, 1 / 3, 1 / 3))
    if not n_train:
        table[:] = (0.0, 0.0, 1.0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left.to_pylist()[0])
        (s_kept, s_deleted), (p_kept, p_deleted) = answered(b, right)
        single, pair = (s_kept + s_deleted)[b.single], p_kept + p_deleted
        count, before = single[b.word], single[b.context]
        w = table[bucket(before)]
        p = w[:, 0] * pair[b.pair] / np.maximum(before, 1) + w[:, 1] * count / max(n_train, 1) + w[:, 2] / (v_train + 1)
        base = np.log10((count + 0.1) / (n_train + 0.1 * (v_train + 1)))
        starts = np.cumsum(b.sizes) - b.sizes
        return pa.table({
            "doc_id": pa.array(b.doc_ids, pa.int64()), "held_out": b.roles == HELD_OUT, "n_tokens": b.sizes, "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
            "train_tokens": np.full(len(starts), n_train, np.int64), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts),
        })

    n = max(1, total["batches"])
    left, right = (x.repartition(n, "batch").groupBy("batch") for x in (batches, by_batch))
    return left.cogroup(right).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
