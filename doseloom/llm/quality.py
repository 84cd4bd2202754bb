"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Words are runs of letters and digits, and runs of other visible characters, so that junk
marks are words of their own. Two streams are hashed, the lower-cased words and their
shapes (letter case, kind and length of a mark, whether the word repeats the one before
or the one before that); a feature is a run of 1 or 2 of either stream, hashed to
``2 ** BITS`` slots. A document's vector holds each slot's share of its words.

Training takes labelled rows whose held-out remainder is not 0, at most ``sample`` of them in
the order of a hash of the id (the documented bound of the fit). The rows are dealt to ``SHARDS``
tasks; each pass, every shard runs follow-the-regularised-leader updates over its rows from the
common state and the states are averaged. A score is one sparse dot product.

Defined results: null and empty texts have no features and score the intercept; rows of
``labels`` with a null id or label are not learned from, repeated labels of an id are
averaged and rounded up, repeated rows are scored each; without labelled rows
every score is 0.5; an empty table gives no rows; columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.llm.tables import as_batch, held_out, saved, text_rows, whole_text
from doseloom.llm.text import LOWER, U, Texts, mix, portions

BITS = 18
SHARDS = 8
_KIND = np.full(256, 2, np.uint8)  # 0 space or control, 1 letter, digit or non-ASCII byte, 2 other mark
_KIND[:0x21] = _KIND[0x7F] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _streams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, shape hashes and each text's first word."""
    kind = _KIND[texts.data]
    n = len(kind)
    first = np.empty(n, bool)
    first[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
    edges = np.append(np.flatnonzero(first), n)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    words = texts.hashes(starts, ends)
    begin = np.searchsorted(starts, texts.offsets)
    upper = np.cumsum(np.append(0, (texts.data >= 65) & (texts.data <= 90)))
    capitals = upper[ends] - upper[starts]
    size = ends - starts
    case = np.where(capitals == 0, 0, np.where(capitals == 1, 1, np.where(capitals * 2 >= size, 3, 2)))
    again = np.zeros(len(words), np.int64)
    for back in (2, 1):
        same = np.flatnonzero(words[back:] == words[:-back]) + back
        doc = np.searchsorted(begin, same, "right") - 1
        again[same[same - back >= begin[doc]]] = back
    mark = kind[starts] == 2
    shape = np.where(mark, 16 + np.minimum(size, 4), case) * 4 + again
    return words, np.where(mark & (again == 0), words, mix(shape.astype(U) + U(77))), begin


def features(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: sorted distinct slots and their shares."""
    words, shapes, begin = _streams(texts)
    streams = []
    for salt, s in enumerate((words, shapes)):
        streams.append(mix(s ^ U(salt + 1)) >> U(64 - BITS))
        pair = np.zeros(len(s), U)
        pair[:-1] = mix(s[:-1] * U(3) ^ mix(s[1:] + U(salt + 11))) >> U(64 - BITS)
        streams.append(pair)
    for d in range(len(texts)):
        a, b = int(begin[d]), int(begin[d + 1])
        slots = np.sort(np.concatenate([s[a:b if k % 2 == 0 else max(a, b - 1)] for k, s in enumerate(streams)]).astype(np.int64))
        if not len(slots):
            yield slots, np.zeros(0)
            continue
        at = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        yield slots[at], np.diff(np.append(at, len(slots))) / (b - a)


class Ftrl:
    """Per-slot state of follow-the-regularised-leader with proximal L1 and L2 terms."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        pull = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def learn_shard(own: Ftrl, table: pa.Table, turn: int) -> None:
    """One pass over a shard's rows, which stay flat arrays: as Python numbers they take ten times their size."""
    slots, shares = (table.column(c).combine_chunks() for c in ("slots", "shares"))
    edges, marks = slots.offsets.to_numpy(), table.column("label").to_numpy()
    slots, shares = slots.values.to_numpy(), shares.values.to_numpy()
    order = np.argsort(mix(table.column("doc_id").to_numpy().astype(U) + U(turn)))
    for k in order.tolist():
        a, b = edges[k], edges[k + 1]
        own.learn(np.append(slots[a:b], len(own.z) - 1), np.append(shares[a:b], 1.0), marks[k])


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> DataFrame:
    """``doc_id, label, text`` of at most ``sample`` labelled ids outside the held-out part.

    Of an id that comes with several texts the one with the least digest is taken, so every run learns from the same.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("label")) \
        .where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` ids: broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")).alias("least")
    return rows.groupBy("doc_id", "label").agg(least).select("doc_id", "label", "least.text")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = 20_000, passes: int = 4) -> np.ndarray:
    """The weights: ``2 ** BITS`` slots and the intercept."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("label", pa.int32()), ("slots", pa.list_(pa.int32())),
                        ("shares", pa.list_(pa.float32()))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches):
            found = list(features(texts))
            yield as_batch({"shard": [d % SHARDS for d in batch.column(0).to_pylist()], "doc_id": batch.column(0),
                            "label": batch.column(1).cast(pa.int32()), "slots": [f[0] for f in found],
                            "shares": [f[1] for f in found]}, schema)

    rows = labelled(docs, labels, column, sample).select("doc_id", "label", "text")
    rows = saved(rows.mapInArrow(vectors, "shard int, doc_id long, label int, slots array<int>, shares array<float>"), "vectors") \
        .repartition(SHARDS, "shard")
    size = (1 << BITS) + 1
    state = Ftrl(size)
    spark = docs.sparkSession
    for turn in range(passes):
        common = spark.sparkContext.broadcast((state.z, state.n))

        def learned(table: pa.Table) -> pa.Table:
            own = Ftrl(size)
            own.z, own.n = (x.copy() for x in common.value)
            learn_shard(own, table, turn)
            at = np.flatnonzero((own.n != common.value[1]) | (own.z != common.value[0]))
            return pa.table({"slots": [at.astype(np.int32).tobytes()], "z": [own.z[at].tobytes()], "n": [own.n[at].tobytes()]})

        z, n, shards = np.zeros(size), np.zeros(size), 0
        # One row per shard, of the model's size at most.
        for part in rows.groupBy("shard").applyInArrow(learned, "slots binary, z binary, n binary").collect():
            at = np.frombuffer(part.slots, np.int32)
            z[at] += np.frombuffer(part.z) - state.z[at]
            n[at] += np.frombuffer(part.n) - state.n[at]
            shards += 1
        if not shards:
            break
        # A slot's state moves by the mean over the shards; n counts what all of them saw.
        state.z, state.n = state.z + z / shards, state.n + n / shards
        common.unpersist()
    return state.weights()


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 1 MB at 18 bits

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch, texts in portions(batches):
            dots = np.array([w[s] @ v for s, v in features(texts)]) + w[-1]
            yield as_batch({"doc_id": batch.column(0), "score": 1 / (1 + np.exp(-dots))}, _SCORED)

    return text_rows(docs).mapInArrow(scored, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    out = scores(docs, fit(docs, labels, sample=sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
