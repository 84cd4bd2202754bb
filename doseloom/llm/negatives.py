"""Hard negatives by slots: the positives' upper limits cut an anchor's scores into disjoint slots.

A window of an anchor and one of its positives reaches from a lower share of the positive's score up
to an upper share of it. Windows of one anchor overlap, so a negative may serve several. The upper limits,
in descending order, split all scores into disjoint slots. While a task scores its rows it
keeps, for each anchor and slot, only the ``keep`` best negatives, and the shuffle keeps ``keep`` of these for
each anchor and slot again. A window's answers begin in the slot under its own upper limit and go
down through the slots after it, so one walk from the highest slot to the lowest answers every window of
the anchor: its first ``keep`` entries from its slot on, cut at its lower limit. No window is scored
on its own, and no pair of rows leaves a task unless it is among the best of its slot there.

The anchors are a stated query set. They are taken in blocks of at most ``block`` vectors, one block at a time
is broadcast (its bytes are bounded by ``block`` and the vectors' length), and all rows are scored against it.

Scores are inner products of whole numbers, exact: in 64-bit floating point while every product's sum stays
under 2 ** 40, else with Python's whole numbers.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part;
a shorter vector counts as filled with zeros; ties go by the smaller id, then by the vector's digest; rows that repeat an id
are rows of their own, as anchors too; a score beyond 64 bits counts as the nearest 64-bit number;
a table without rows, anchors, positives or negatives gives no rows; columns other than the id,
vector and label are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseloom.llm.tables import saved
from doseloom.plans.storage import new_folder

_EXACT = float(1 << 40)  # scores below it stay exact in a double, also next to a place among 2 ** 12 rows
_ROWS = 4096
_MOST = (1 << 63) - 1
_FOUND = pa.schema([(c, pa.int32() if c == "slot" else pa.int64()) for c in ("anchor", "anchor_id", "slot", "score", "vec_id", "digest")])
_FOUND_SQL = "anchor long, anchor_id long, slot int, score long, vec_id long, digest long"


def vectors(embeddings: DataFrame, scale: int = 256, mislabel: int = 7, classes: int = 10) -> DataFrame:
    """``row, vec_id, label, v, digest``: whole-number vectors of the rows that take part.

    Where ``vec_id`` is divisible by ``mislabel`` the label becomes ``(label + 1) % classes``.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    # Not F.floor: it gives a long, which large components don't fit.
    def floor(x):
        return F.rint(x) - (F.rint(x) > x).cast("double")
    whole = F.transform("embedding", lambda x: floor(x.cast("double") * scale))
    return embeddings.where(vec_id.isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & usable) \
        .select(vec_id.alias("vec_id"), F.when(vec_id % mislabel == 0, (label + 1) % classes).otherwise(label).alias("label"),
                whole.alias("v")) \
        .withColumn("digest", F.xxhash64("label", "v")).withColumn("row", F.monotonically_increasing_id())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, cut or filled with zeros at ``width``."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] >= width:
        return flat.reshape(len(sizes), sizes[0])[:, :width]
    out, at = np.zeros((len(sizes), width)), 0
    for k, n in enumerate(sizes.tolist()):
        out[k, :n] = flat[at:at + n][:width]
        at += n
    return out


def scored(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, rows x anchors: whole doubles, or Python's whole numbers where those could be inexact."""
    bound = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, rows.shape[1])
    if bound < _EXACT:
        return rows @ anchors.T
    left, right = ([[int(x) for x in r] for r in m.tolist()] for m in (rows, anchors))
    out = np.empty((len(left), len(right)), object)
    for i, r in enumerate(left):
        for j, a in enumerate(right):
            out[i, j] = max(-_MOST - 1, min(_MOST, sum(x * y for x, y in zip(r, a))))
    return out


def best(scores: np.ndarray, allowed: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``keep`` highest allowed scores of each column; rows of equal score in row order."""
    n = len(scores)
    if scores.dtype == object:
        pairs = [(r, c) for c in range(scores.shape[1])
                 for r in sorted(np.flatnonzero(allowed[:, c]).tolist(), key=lambda r: (-scores[r, c], r))[:keep]]
        rows, columns = np.array(pairs, np.int64).reshape(-1, 2).T
        return rows, columns
    # One number ranks score and place: higher scores first, then earlier rows.
    ranked = np.where(allowed, scores * n + np.arange(n - 1, -1, -1.0)[:, None], -np.inf)
    if n > keep:
        top = np.argpartition(ranked, n - keep, axis=0)[n - keep:]
    else:
        top = np.broadcast_to(np.arange(n)[:, None], ranked.shape)
    columns = np.broadcast_to(np.arange(ranked.shape[1]), top.shape)
    hit = ranked[top, columns] > -np.inf
    return top[hit], columns[hit]


def _kept(parts: list[dict[str, np.ndarray]], keep: int) -> dict[str, np.ndarray]:
    """The ``keep`` best of each anchor and slot among the parts."""
    every = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.lexsort((every["digest"], every["vec_id"], ~every["score"], every["slot"], every["anchor"]))
    every = {c: x[order] for c, x in every.items()}
    new = np.ones(len(order), bool)
    new[1:] = (every["anchor"][1:] != every["anchor"][:-1]) | (every["slot"][1:] != every["slot"][:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return {c: x[place < keep] for c, x in every.items()}


def _slots(score: np.ndarray, same: np.ndarray, positives: np.ndarray, window: tuple[int, int, int]) -> Iterator[np.ndarray]:
    """For each slot, which negatives lie in it: at or under its limit, over the next, not under its own window.

    ``positives`` has a row of scores per slot, descending; -inf fills up, and nothing lies at or under it.
    """
    low, high, of = window
    times = score * of
    for s, top in enumerate(positives):
        inside = ~same & (times <= top * high) & (times >= top * low)
        yield inside & ~(times <= positives[s + 1] * high) if s + 1 < len(positives) else inside


def _tops(table: DataFrame, block: list, positives: np.ndarray | None, window: tuple[int, int, int], keep: int) -> DataFrame:
    """The ``keep`` best rows of each anchor and slot: of its own label without ``positives``, else of the others."""
    spark, width = table.sparkSession, max(len(r.v) for r in block)
    matrix = np.zeros((len(block), width))
    for k, r in enumerate(block):
        matrix[k, :len(r.v)] = r.v
    names = np.array([(r.row, r.vec_id, r.label) for r in block], np.int64).T
    shared = spark.sparkContext.broadcast((matrix, names, positives))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (own, own_id, own_label), limits = shared.value
        held: list[dict[str, np.ndarray]] = []
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label", "digest")}
                order = np.lexsort((col["digest"], col["vec_id"]))
                col = {c: x[order] for c, x in col.items()}
                score = scored(_matrix(batch.column("v"), width)[order], anchors)
                same = col["label"][:, None] == own_label[None, :]
                slots = [same & (col["row"][:, None] != own[None, :])] if limits is None else _slots(score, same, limits, window)
                for s, allowed in enumerate(slots):
                    if allowed.any():
                        r, c = best(score, allowed, keep)
                        held.append({"anchor": own[c], "anchor_id": own_id[c], "slot": np.full(len(r), s, np.int32),
                                     "score": score[r, c].astype(np.int64), "vec_id": col["vec_id"][r], "digest": col["digest"][r]})
            if sum(len(h["slot"]) for h in held) > 1 << 20:
                held = [_kept(held, keep)]
        if held:
            yield pa.RecordBatch.from_pydict(_kept(held, keep), schema=_FOUND)

    rank = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "digest")
    return table.mapInArrow(found, _FOUND_SQL).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= keep)


def _answers(positives: DataFrame, negatives: DataFrame, window: tuple[int, int, int], keep: int) -> DataFrame:
    """Every window's rows from its anchor's slots, which one descending walk lines up."""
    low, high, of = window
    walk = F.array_sort(F.collect_list(F.struct("slot", (-F.col("score").cast("decimal(38,0)")).alias("order"), "vec_id", "digest", "score")))
    lines = negatives.groupBy("anchor").agg(walk.alias("walk"))
    as_decimal = lambda c: c.cast("decimal(20,0)")  # noqa: E731  a hundredfold score may not fit a long
    inside = F.filter("walk", lambda n: (n["slot"] >= F.col("place") - 1)
                      & (as_decimal(n["score"]) * of >= as_decimal(F.col("positive_score")) * low))
    return positives.join(lines, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, keep)).alias("at", "negative")) \
        .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.vec_id").alias("negative_id"),
                "positive_score", F.col("negative.score").alias("negative_score"))


def mined(embeddings: DataFrame, every: int = 100, positives: int = 5, keep: int = 5, low: int = 80, high: int = 100, of: int = 100,
          scale: int = 256, mislabel: int = 7, classes: int = 10, block: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``; each one's positives are the ``positives`` best other rows
    of its label; each window holds the ``keep`` best rows of other labels with
    ``low * positive_score <= of * negative_score <= high * positive_score``.
    """
    if not 0 <= low <= high or of <= 0:
        raise ValueError("a window needs 0 <= low <= high and of > 0")
    spark, window = embeddings.sparkSession, (low, high, of)
    table = saved(vectors(embeddings, scale, mislabel, classes), "vectors")
    uri = new_folder(spark, "negatives")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], empty).write.parquet(uri)
    queries = table.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v").toLocalIterator()
    while own := list(itertools.islice(queries, block)):
        near = saved(_tops(table, own, None, window, positives), "positives")
        place = {r.row: k for k, r in enumerate(own)}
        found = near.select("anchor", "place", "score").collect()  # at most ``positives`` rows for each anchor of the block
        limits = np.full((positives, len(own)), -np.inf, object if any(abs(r.score) >= _EXACT for r in found) else float)
        for r in found:
            limits[r.place - 1, place[r.anchor]] = r.score
        slots = saved(_tops(table, own, limits, window, keep), "slots")
        named = near.select("anchor", "anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        _answers(named, slots, window, keep).write.mode("append").parquet(uri)
    return spark.read.schema(empty).parquet(uri)
