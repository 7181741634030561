"""A quality classifier by co-training on two views.

One classifier sees the text's content, the other the metadata (source, language, length).  Both are logistic
regressions, fitted on a bounded sample of labelled documents.  In each round both score every document without a
label, each gives the `gain` documents of either label that it is surest of to the other one to learn from, and both
are fitted anew.  Each view is calibrated on labelled documents that neither has learnt from, and the two calibrated
views together score every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sequent.llm import words
from sequent.llm.shared import WORD, stored

_CLASS = np.full(256, 5, np.uint8)  # other ASCII marks
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 7
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[128:] = 6
_PAIRS = np.arange(64)
#: Places of the metadata view: sources, languages and binary lengths are hashed or cut into so many.
SOURCES, LANGS, LENGTHS = 64, 16, 24


def ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def content(texts: list[str | None]) -> np.ndarray:
    """Content features of each text: shares of character classes and their pairs, and how much is repeated."""
    hashes, counts = words.word_hashes(texts)
    out, at = np.zeros((len(texts), 72), np.float64), 0
    for k, (text, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
        own = hashes[at : at + n]
        at += n
        if not n:
            continue
        kinds = _CLASS[np.frombuffer(text.encode(), np.uint8)]
        out[k, :64] = np.sqrt(np.bincount((kinds[:-1].astype(np.int64) << 3) | kinds[1:], minlength=64) / len(kinds))
        _, times = np.unique(own, return_counts=True)
        lines = text.split("\n")
        triples = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
        out[k, 64:] = (
            np.log1p(n) / 10, len(kinds) / n / 10, len(times) / n ** 0.85, times.max() / n, ratio(len(np.unique(triples)), len(triples)),
            ratio(int((own[1:] == own[:-1]).sum()), n - 1), len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10,
        )
    return out


def metadata(sources: list[str | None], langs: list[str | None], sizes: list[int | None]) -> np.ndarray:
    """Metadata features: one place for each hashed source, language and binary length; a null has the first one."""
    import zlib

    out = np.zeros((len(sources), SOURCES + LANGS + LENGTHS))
    for k, (source, lang, size) in enumerate(zip(sources, langs, sizes, strict=True)):
        out[k, 0 if source is None else 1 + zlib.crc32(source.encode()) % (SOURCES - 1)] = 1
        out[k, SOURCES + (0 if lang is None else 1 + zlib.crc32(lang.encode()) % (LANGS - 1))] = 1
        out[k, SOURCES + LANGS + (0 if size is None or size < 0 else min(LENGTHS - 1, 1 + int(size).bit_length()))] = 1
    return out


class Logistic:
    """Ridge logistic regression on standardised, clipped features, by Newton's method in chunks of rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
        self.scale[self.scale < 1e-9] = 1
        size = x.shape[1] + 1
        self.w = np.zeros(size)
        penalty = np.full(size, ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            slope, bend = -penalty * self.w, np.diag(penalty)
            for at in range(0, len(x), 2048):
                z = self._ready(x[at : at + 2048])
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                slope += z.T @ (y[at : at + 2048] - p)
                bend += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
            step = np.linalg.solve(bend, slope)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -6, 6)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        parts = [self._ready(x[at : at + 2048]) @ self.w for at in range(0, len(x), 2048)]
        return np.clip(np.concatenate(parts) if parts else np.zeros(0), -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


class CoTrained:
    """Two views' classifiers, their calibrations and their combination; `held` labelled rows are for calibration."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, held: np.ndarray):
        self._known, self._y, self._held = views, y, held
        self._extra: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        self.fit()

    def learn(self, v: int, x: np.ndarray, label: float) -> None:
        """Take rows of view v with a pseudo-label."""
        self._extra[v].append((x, np.full(len(x), label)))

    def fit(self) -> None:
        train, held = ~self._held, self._held
        self.views = [Logistic(np.concatenate([self._known[v][train], *(x for x, _ in self._extra[v])]), np.concatenate([self._y[train], *(y for _, y in self._extra[v])])) for v in (0, 1)]
        self.scales = [Logistic(self.views[v].logit(self._known[v][held])[:, None], self._y[held], 1e-3) for v in (0, 1)]

    def light(self) -> CoTrained:
        """The views and their calibrations alone, as tasks need them."""
        other = object.__new__(CoTrained)
        other.views, other.scales = self.views, self.scales
        return other

    def finish(self, spare: float) -> None:
        """Fit the combination, choose the acceptance threshold, and let the training rows go.

        The threshold is the score that a share `spare` of the calibration set's good documents lies below, between
        0.05 and 0.5: it asks for no more than what keeps the others.
        """
        both = np.stack([self.log_odds(v, self._known[v][self._held]) for v in (0, 1)], 1)
        y = self._y[self._held]
        self.joint = Logistic(both, y, 1e-1)
        self.accept = float(np.clip(np.quantile(self.joint.probability(both)[y == 1], spare, method="lower"), 0.05, 0.5))
        del self._known, self._y, self._held, self._extra

    def log_odds(self, v: int, x: np.ndarray) -> np.ndarray:
        return self.scales[v].logit(self.views[v].logit(x)[:, None])

    def calibrated(self, v: int, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(v, x)))

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by content, by metadata and by both."""
        both = np.stack([self.log_odds(v, views[v]) for v in (0, 1)], 1)
        return self.calibrated(0, views[0]), self.calibrated(1, views[1]), self.joint.probability(both)


def as_views(rows: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows[c].to_pylist()), "<f4").reshape(rows.num_rows, -1) for c in ("content", "metadata")]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of what the features are made of), content, metadata of every document that has a word."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [content(part["text"].to_pylist()), metadata(*(part[c].to_pylist() for c in ("source", "lang", "n_chars")))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], *(pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()) for x in own)], names=["doc_id", "key", "content", "metadata"])

    rows = docs.where(F.col("text").rlike(WORD)).select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.withColumn("key", F.xxhash64("text", "source", "lang", "n_chars"))
    return rows.mapInArrow(features, "doc_id long, key long, content binary, metadata binary")


def surest(model: CoTrained, sure: float, gain: int, taken: np.ndarray):
    """Documents without a label -> (view, label, key, doubt): the `gain` different ones of a task that each view is surest of."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(v, label): (np.zeros(0, np.int64), np.zeros(0)) for v in (0, 1) for label in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            views, key = as_views(batch), batch["key"].to_numpy()
            free = ~np.isin(key, taken)
            for v in (0, 1):
                good = np.round(model.calibrated(v, views[v]), 9)  # so that equal rows are equal wherever they are scored
                for label in (0, 1):
                    doubt = 1 - good if label else good
                    some = free & (doubt <= 1 - sure)
                    keys, first = np.unique(np.concatenate([best[v, label][0], key[some]]), return_index=True)
                    doubts = np.concatenate([best[v, label][1], doubt[some]])[first]
                    order = np.lexsort((keys, doubts))[:gain]
                    best[v, label] = keys[order], doubts[order]
        for (v, label), (keys, doubts) in best.items():
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(keys), pa.array(doubts)], names=["view", "label", "key", "doubt"])

    return pick


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int, rounds: int, sure: float, gain: int, spare: float, seed: int) -> CoTrained | None:
    """The co-trained model; None if the labelled sample does not hold both labels twice."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    every = stored(featured(docs).join(known, "doc_id", "left"), "quality-features")
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    own = every.where("label is not null").groupBy("doc_id").agg(F.min_by(F.struct("key", "label", "content", "metadata"), "key").alias("x"))
    rows = own.orderBy(order, "doc_id").limit(max_labelled).select("x.*").toArrow().sort_by("key")  # max_labelled rows of 700 bytes
    y = rows["label"].to_numpy().astype(float)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    held = np.zeros(len(y), bool)
    for value in (0, 1):  # every fourth of either label is for calibration
        held[np.flatnonzero(y == value)[1::4]] = True
    model, taken = CoTrained(as_views(rows), y, held), np.zeros(0, np.int64)
    pool = every.where("label is null").drop("label", "doc_id")
    for _ in range(rounds):
        found = pool.mapInArrow(surest(model.light(), sure, gain, taken), "view int, label int, key long, doubt double")
        found = found.groupBy("view", "label", "key").agg(F.min("doubt").alias("doubt"))
        place = F.row_number().over(W.Window.partitionBy("view", "label").orderBy("doubt", "key"))
        picked = found.withColumn("place", place).where(F.col("place") <= gain).select("view", "label", "key").toPandas()  # 4 x gain rows
        if not len(picked):
            break
        keys = np.unique(picked["key"].to_numpy())
        asked = docs.sparkSession.createDataFrame([(int(k),) for k in keys], "key long")
        got = pool.join(F.broadcast(asked), "key").groupBy("key").agg(F.first("content").alias("content"), F.first("metadata").alias("metadata")).toArrow().sort_by("key")
        views, at = as_views(got), {k: n for n, k in enumerate(got["key"].to_pylist())}
        torn = set(picked.groupby("key").label.nunique().loc[lambda n: n > 1].index)  # of two minds: nobody learns from it
        for v in (0, 1):
            for label in (0, 1):
                own = sorted(at[k] for k in picked.key[(picked.view == v) & (picked.label == label)] if k not in torn)
                model.learn(1 - v, views[1 - v][own], label)
        taken = np.union1d(taken, keys)
        model.fit()
    model.finish(spare)
    return model


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, rounds: int = 5, sure: float = 0.98, gain: int = 1_000, accept: float | None = None, spare: float = 0.01, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, source, lang, n_chars) with text_score, metadata_score, quality_score and accepted.

    labels: doc_id, quality (1 good, 0 bad; other values and null ids are not used; of two labels the better one
    counts).  At most max_labelled labelled documents are learnt from, the first in the order of a seeded hash; of
    rows that share a doc_id, one.  All other documents are candidates for pseudo-labels in every round; of equal
    certainty those with the smaller hash go first, and equal documents count once.  Every document is scored, from
    its whole text, however long.  accepted: quality_score is `accept` or more; by default that threshold is chosen
    so that a share `spare` of the calibration set's good documents is lost (see CoTrained.finish).  A null, empty or
    blank text has a quality_score of 0 and is not accepted.  Without labels of both kinds every other document has
    null scores and is accepted.  All rows of docs are kept, and all columns but those that have the names of the new
    ones, which are replaced.  No rows: no rows.
    """
    model = fitted(docs, labels, max_labelled, rounds, sure, gain, spare, seed)
    least = None if model is None else model.accept if accept is None else accept
    names = ["text_score", "metadata_score", "quality_score", "accepted"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part["text"].to_pylist()
                views = [content(texts), metadata(*(part[c].to_pylist() for c in ("source", "lang", "n_chars")))]
                blank = np.array([not t or not t.encode().strip() for t in texts], bool)
                if model is None:
                    scores = [pa.nulls(len(texts), pa.float64())] * 2 + [pa.array(np.zeros(len(texts)), mask=~blank)]
                    accepted = ~blank
                else:
                    by_text, by_metadata, both = model.score(views)
                    both[blank] = 0
                    scores, accepted = [pa.array(x) for x in (by_text, by_metadata, both)], both >= least
                kept = [c for c, f in zip(part.columns, part.schema, strict=True) if f.name not in names]
                yield pa.RecordBatch.from_arrays([*kept, *scores, pa.array(accepted)], names=[*(n for n in part.schema.names if n not in names), *names])

    rows = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(rate, f"{schema}, text_score double, metadata_score double, quality_score double, accepted boolean")
