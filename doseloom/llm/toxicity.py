"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the words' beginnings of 4 to 6
bytes (an insult keeps its stem when it is inflected), each hashed to ``2 ** BITS`` slots.
The model adds a weight per term and the dot product of the two terms' factor vectors for
each pair of terms, so a pair can count where neither term does: an insult next to a group's
name weighs more than the sum of both. All pairs cost one pass:
``(sum of factors) ** 2 - sum of squared factors``, halved and summed.

All terms that the sample has in at least ``least`` documents are in the model, also those that say
nothing alone. It is trained by AdaGrad steps over small batches, first on the terms whose share of labels
is ``strange_by`` standard deviations from the mean, then on all; soft thresholds keep at 0 what
labels don't move among the others. Of the models after the first stage and each later pass, the one with
the least loss on a tenth of the rows, which is not trained on, is taken. The fit reads at most ``sample`` labelled rows outside the
held-out part (the documented bound of the fit). These rows are dealt to ``SHARDS`` shards and saved once, each shard's terms
packed into one row, so a pass reads files and shuffles nothing. A pass returns for each shard the terms that it has
changed, in 32 bits; the changes are averaged.

Defined results: null and empty texts score the intercept; labels with a null id or value are
not learned from; repeated rows are scored each; without labelled rows every
score is 0.5 and nothing is rejected; an empty table gives no rows; ``scores`` reads no other
columns than ``doc_id`` and ``text``, ``accepted`` keeps all columns and drops documents that
score ``threshold`` or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.llm.quality import labelled
from doseloom.llm.tables import as_batch, held_out, saved, text_rows
from doseloom.llm.text import U, Texts, distinct, mix, portions

BITS = 22
FACTORS = 4
SHARDS = 8
_LEAST_STEPS = 100
_WEIGHT_L1, _FACTOR_L1 = 0.3, 0.5
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
WORD[0x80:] = True
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Machine:
    """``slots`` of the known terms, their weights and factors, and the intercept."""

    slots: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def index(self) -> np.ndarray:
        """Row of each slot, -1 where the model doesn't know it."""
        table = np.full(1 << BITS, -1, np.int32)
        table[self.slots] = np.arange(len(self.slots))
        return table

    def value(self, rows: np.ndarray) -> float:
        v = self.factor[rows]
        total = v.sum(0)
        return self.bias + self.weight[rows].sum() + 0.5 * float(total @ total - (v * v).sum())


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all terms in text order, and each text's first place among them."""
    starts, ends, first = texts.words(WORD)
    size = ends - starts
    parts = [(mix(texts.hashes(starts, ends) + U(1)), np.ones(len(starts), bool))]
    for k in (4, 5, 6):
        parts.append((mix(texts.hashes(starts, np.minimum(starts + k, ends)) + U(k)), size > k))
    slots = np.stack([h >> U(64 - BITS) for h, _ in parts], 1).astype(np.int64)
    keep = np.stack([k for _, k in parts], 1)
    begin = np.append(0, np.cumsum(keep.sum(1)))[first]
    return slots[keep], begin


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def _sums(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Column sums of the rows of each group."""
    return np.stack([np.bincount(group, column, groups) for column in rows.T], 1)


def _train(model: Machine, docs: list[np.ndarray], labels: np.ndarray, order: np.ndarray, told: np.ndarray, l2: float,
           everything: bool, batch: int = 32) -> None:
    """AdaGrad over batches of the logistic loss; few rows are gone through several times.

    Terms in ``told`` say something alone: they are trained by themselves at first, then with
    ``everything``, where only the others shrink.
    """
    order = np.tile(order, max(1, -(-_LEAST_STEPS * batch // max(1, len(order)))))
    rate, least = (1.0, 1.0) if everything else (0.3, 1e-6)
    docs = docs if everything else [d[told[d]] for d in docs]
    gw, gv, gb = np.full(len(model.weight), least), np.full(model.factor.shape, least), 1e-6
    for a in range(0, len(order), batch):
        own = order[a:a + batch]
        lengths = np.array([len(docs[k]) for k in own])
        rows = np.concatenate([docs[k] for k in own])
        at = np.repeat(np.arange(len(own)), lengths)
        v = model.factor[rows]
        total = _sums(v, at, len(own))
        squares = np.bincount(at, (v * v).sum(1), len(own))
        x = model.bias + np.bincount(at, model.weight[rows], len(own)) + 0.5 * ((total * total).sum(1) - squares)
        error = _sigmoid(x) - labels[own]
        known, back = np.unique(rows, return_inverse=True)
        step = np.bincount(back, error[at], len(known)) + l2 * model.weight[known]
        gw[known] += step * step
        pace, shrink = rate / np.sqrt(gw[known]), everything * ~told[known]
        model.weight[known] = _shrunk(model.weight[known] - pace * step, pace * shrink * _WEIGHT_L1)
        step = _sums(error[at][:, None] * (total[at] - v), back, len(known)) + l2 * model.factor[known]
        gv[known] += step * step
        pace = 0.2 * rate / np.sqrt(gv[known])
        model.factor[known] = _shrunk(model.factor[known] - pace * step, pace * shrink[:, None] * _FACTOR_L1)
        gb += error.sum() ** 2
        model.bias -= rate * error.sum() / np.sqrt(gb)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = 20_000, least: int = 8, passes: int = 6,
        passes_on_all: int = 5, l2: float = 0.02, strange_by: float = 5.0) -> Machine:
    spark = docs.sparkSession
    rows = saved(labelled(docs, labels, column, sample).select("doc_id", "label", "text"), "labelled")

    def slots_of(batch: pa.RecordBatch, texts: Texts) -> list[np.ndarray]:
        slots, begin = terms(texts)
        return [distinct(slots[a:b]) for a, b in zip(begin[:-1], begin[1:])]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many of a task's documents, and of those with label 1, hold a slot."""
        seen = np.zeros((1 << BITS, 2), np.int32)
        for batch, texts in portions(batches):
            for own, label in zip(slots_of(batch, texts), batch.column(1).to_pylist()):
                seen[own, 0] += 1
                seen[own, 1] += label
        at = np.flatnonzero(seen[:, 0])
        for a in range(0, len(at), 1 << 16):
            part = at[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (part, seen[part, 0], seen[part, 1])], ["slot", "n", "k"])

    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
    if not facts.n:
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    # Every term of ``least`` documents is in the model, also one that says nothing alone: a pair of such may.
    strange = F.abs(F.col("k") - F.col("n") * F.lit(facts.share)) / F.sqrt(F.col("n") * F.lit(max(facts.share * (1 - facts.share), 1e-9)))
    known = rows.mapInArrow(counted, "slot int, n int, k int").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("k").alias("k")) \
        .where(F.col("n") >= least).select("slot", (strange >= strange_by).alias("told")).toArrow().sort_by("slot")
    slots, told = (known.column(c).to_numpy() for c in ("slot", "told"))
    slots, told = slots.astype(np.int64), told.astype(bool)
    model = Machine(slots, np.zeros(len(slots)), np.zeros((len(slots), FACTORS)), 0.0)
    model.factor[told] = np.random.default_rng(11).normal(0, 0.01, (int(told.sum()), FACTORS))  # the others begin with the second stage
    shared_slots, shared_told = spark.sparkContext.broadcast(slots.astype(np.int32)), spark.sparkContext.broadcast(told)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents' terms as places in the model."""
        own = shared_slots.value
        for batch, texts in portions(batches):
            found = [np.searchsorted(own, x[np.isin(x, own, assume_unique=True)]).astype(np.int32).tobytes() for x in slots_of(batch, texts)]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([d % SHARDS for d in batch.column(0).to_pylist()], pa.int32()),
                                              "doc_id": batch.column(0), "label": batch.column(1).cast(pa.int32()), "places": found})

    def packed(table: pa.Table) -> pa.Table:
        """A shard as one row, in order of its ids."""
        table = table.sort_by("doc_id")
        places = table.column("places").to_pylist()
        return pa.table({"ids": [table.column("doc_id").to_numpy().tobytes()], "labels": [table.column("label").to_numpy().tobytes()],
                         "sizes": [np.array([len(p) // 4 for p in places], np.int32).tobytes()], "places": [b"".join(places)]})

    shards = saved(rows.mapInArrow(listed, "shard int, doc_id long, label int, places binary").groupBy("shard")
                   .applyInArrow(packed, "ids binary, labels binary, sizes binary, places binary"), "shards")
    best, least_loss = model, np.inf
    for turn in range(passes + passes_on_all + 1):  # the last one only weighs the model
        start = model.factor.copy()
        if turn == passes:  # the second stage sets out from small factors; the model that is weighed here has none of them
            start[~told] = np.random.default_rng(12).normal(0, 0.1, (int((~told).sum()), FACTORS))
        common = spark.sparkContext.broadcast((model.weight.astype(np.float32), start.astype(np.float32), model.bias))

        def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, factor, bias = common.value
            strange_ones = shared_told.value
            for batch in batches:
                for shard in batch.to_pylist():
                    ids, marks, sizes = (np.frombuffer(shard[c], d) for c, d in (("ids", np.int64), ("labels", np.int32), ("sizes", np.int32)))
                    lists = np.split(np.frombuffer(shard["places"], np.int32), np.cumsum(sizes)[:-1])
                    own = Machine(np.zeros(0, np.int64), weight.astype(float), factor.astype(float), bias)
                    aside = mix(ids.astype(U) + U(99)) % U(10) == 0
                    loss = 0.0
                    if turn >= passes:
                        plain = Machine(own.slots, own.weight, np.where(strange_ones[:, None], own.factor, 0) if turn == passes else own.factor, bias)
                        margins = np.array([plain.value(lists[k]) for k in np.flatnonzero(aside)])
                        loss = float(np.logaddexp(0, np.where(marks[aside] == 1, -margins, margins)).sum())
                    order = np.argsort(mix(ids.astype(U) + U(turn)))
                    order = order[~aside[order]]
                    if turn < passes + passes_on_all and len(order):
                        _train(own, lists, marks, order, strange_ones, l2 / len(lists), turn >= passes)
                    moved = np.column_stack([own.weight - weight, own.factor - factor]).astype(np.float32)
                    at = np.flatnonzero(moved.any(1))
                    yield pa.RecordBatch.from_pydict({"loss": [loss], "bias": [float(own.bias)], "at": [at.astype(np.int32).tobytes()],
                                                      "moved": [moved[at].tobytes()]})

        # A row per shard; what it has changed is of the model's size at most.
        found = shards.mapInArrow(learned, "loss double, bias double, at binary, moved binary").toArrow()
        loss = sum(found.column("loss").to_pylist())
        if turn >= passes and loss < least_loss:
            best, least_loss = model, loss
        change = np.zeros((len(slots), 1 + FACTORS))
        for at, moved in zip(found.column("at"), found.column("moved")):
            change[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(moved.as_buffer(), np.float32).reshape(-1, 1 + FACTORS)
        change /= found.num_rows
        model = Machine(slots, model.weight + change[:, 0], start + change[:, 1:], float(np.mean(found.column("bias").to_pylist())))
        common.destroy()
    shared_slots.destroy()
    shared_told.destroy()
    return best


def _values(model: Machine, index: np.ndarray, texts: Texts) -> np.ndarray:
    slots, begin = terms(texts)
    rows = index[slots]
    out = np.empty(len(texts))
    for d in range(len(texts)):
        own = rows[begin[d]:begin[d + 1]]
        out[d] = model.value(distinct(own[own >= 0]))
    return _sigmoid(out)


def scores(docs: DataFrame, model: Machine) -> DataFrame:
    """``doc_id, score`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.index()
        for batch, texts in portions(batches):
            yield as_batch({"doc_id": batch.column(0), "score": _values(shared.value, index, texts)}, _SCORED)

    return text_rows(docs).mapInArrow(scored, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    out = scores(docs, fit(docs, labels, sample=sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample=sample))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.index()
        for batch, texts in portions((b for b in batches if b.num_rows)):
            yield batch.filter(pa.array(_values(shared.value, index, texts) < threshold))

    return docs.mapInArrow(judged, docs.schema)
