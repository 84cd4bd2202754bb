"""Packing along a Hilbert curve.

Each document's hashed words are summed as random signs in ``DIMS`` dimensions, the point is
put on a grid and numbered along the grid's Hilbert curve. Documents are range-sorted by that
number and laid end to end; the line of ids is cut every ``length`` ids. So every sequence but
the last is full, and neighbours in a sequence are near each other in words.

The steps are: number the documents (words only), range-sort the texts, encode each task's
texts in order, write them with their place in the task, add up the tasks' totals, cut. Only the
totals, one row per task, meet in one place. Ties on the curve go by ``doc_id`` and a hash of
the text, also at the borders of the ranges, so copies can't fill one task.

Defined results: null and empty texts are the end id alone; a null ``doc_id`` is packed like
any other; repeated rows are packed each; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseloom.llm.tables import as_batch, buckets, crc_of, saved, text_rows
from doseloom.llm.text import U, Texts, mix, portions
from doseloom.llm.tokens import encoder
from doseloom.llm.toxicity import WORD

DIMS, GRID_BITS = 4, 10
_KEYED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("curve", pa.int64())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("curve", pa.int64()), ("place", pa.int64()),
                      ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                     ("ids", pa.list_(pa.int32()))])


def grid(texts: Texts) -> np.ndarray:
    """Grid cell of each text: sums of word signs over the root of the word count."""
    starts, ends, first = texts.words(WORD)
    bits = mix(texts.hashes(starts, ends) + U(99))
    n = np.diff(first)
    cells = np.zeros((len(texts), DIMS), np.int64)
    for d in range(DIMS):
        sums = np.append(0, np.cumsum(((bits >> U(d)) & U(1)).astype(np.int64) * 2 - 1))
        point = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(n, 1))
        cells[:, d] = np.clip((point + 8) / 16 * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1)
    return cells


def hilbert(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Number of each grid cell along the Hilbert curve through the grid.

    From the finest cell up, each level's orientation is undone by exchanging or
    inverting lower bits; what is left is the Gray code of the number.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[:, i] & q) > 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    number = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            number = number << 1 | (x[:, i] >> b) & 1
    return number


def ordered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, curve, part``: each task's rows in curve order, tasks in order of ``part``."""
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(grid(texts)))], schema=_KEYED)

    keyed = text_rows(docs).mapInArrow(numbered, "doc_id long, text string, curve long")
    order = ["curve", "doc_id", F.xxhash64("text")]
    return keyed.repartitionByRange(buckets(docs.sparkSession, 1), *order).sortWithinPartitions(*order) \
        .withColumn("part", F.spark_partition_id())


def encoded(docs: DataFrame, tokenizer: str, spaces: str, end_id: int) -> DataFrame:
    """``doc_id, part, curve, place, n, ids``: ids as 32-bit integers, ``place`` counted within ``part``."""
    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch, texts in portions(batches, 1 << 20):
            ids, first = encoder(tokenizer, spaces).encode(texts)
            n = np.diff(first) + 1
            blobs = [np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:])]
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield as_batch({"doc_id": batch.column(0), "part": batch.column(2), "curve": batch.column(3), "place": places, "n": n,
                            "ids": blobs}, _ENCODED)

    rows = ordered(docs).select("doc_id", "text", "part", "curve")
    return rows.mapInArrow(ids_of, "doc_id long, part int, curve long, place long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, spaces: str = "dropped", end_id: int = 1, length: int = 2048,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Without ``with_ids`` the last column is null.
    """
    rows = saved(encoded(docs, tokenizer, spaces, end_id), "encoded")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    begins = rows.groupBy("part").agg(F.sum("n").alias("total")) \
        .select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("begin"))
    placed = rows.join(F.broadcast(begins), "part").select("doc_id", (F.col("begin") + F.col("place")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _PIECES}
            held = 0
            for doc, at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(blob.as_buffer(), "<u4")
                edges = [0, *range(-at % length or length, len(ids), length), len(ids)]
                for a, b in zip(edges[:-1], edges[1:]):
                    piece = ids[a:b]
                    for name, value in zip(out, (doc, a, b - a, crc_of(piece), len(ids), (at + a) // length,
                                                 (at + a) % length, piece.astype(np.int32) if with_ids else None)):
                        out[name].append(value)
                held += len(ids)
                if held > 1_000_000:
                    yield as_batch(out, _PIECES)
                    out, held = {name: [] for name in out}, 0
            if out["doc_id"]:
                yield as_batch(out, _PIECES)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                                  "offset long, ids array<int>")


def pieces(docs: DataFrame, tokenizer: str, spaces: str = "dropped", end_id: int = 1, length: int = 2048) -> DataFrame:
    """The pieces without their ids."""
    return pack(docs, tokenizer, spaces, end_id, length, with_ids=False).drop("ids")
