"""Benchmark decontamination: a broadcast hash set of test n-grams scans the documents.

Words are runs of ASCII letters and digits and of any non-ASCII bytes, A-Z lower-cased.
A window is ``n`` consecutive words of an item; an item with fewer words, but not none,
is one window. The hashes of all windows of a document are looked up in the set; each
hit is verified word by word before it counts.

Only a block of the benchmark of about ``block_bytes`` of words is made and broadcast at a
time. With a larger benchmark each block is a pass over the documents that writes its hits
down and drops its broadcast; the hits are put together at the end, so neither the driver nor a
worker ever holds more than two blocks, whatever the data.

Defined results: null and empty texts have no words and no hits; items without words
match nothing; items that repeat a text are each found, rows that repeat an item id
count as one item; a null item id is left out of the id list but its windows hit;
repeated documents are judged each; an empty table gives no rows, an empty benchmark
no hits; extra columns are kept by ``cleaned`` and not read by ``scan``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseloom.llm.tables import as_batch, free_names, saved, text_rows, whole_text
from doseloom.llm.text import LOWER, Texts, portions, windows
from doseloom.plans.storage import new_folder

WORD = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD[_a:_b + 1] = False
WORD[0x41:0x5B] = True  # A-Z, lower-cased before the test


class Ngrams:
    """The windows of some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.names = [name for name, _ in items]
        at: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        for k, (_, words) in enumerate(items):
            m = min(n, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                at.setdefault(m, {}).setdefault(tuple(words[i:i + m]), set()).add(k)
        self.by_length = {}
        for m, found in at.items():
            grams = list(found)
            flat = [w for g in grams for w in g]
            ends = np.cumsum([len(w) + 1 for w in flat])
            texts = Texts(np.frombuffer(b" ".join(flat) + b" ", np.uint8), np.array([0, ends[-1]]))
            words = texts.hashes(ends - np.array([len(w) + 1 for w in flat]), ends - 1)
            keys = windows(words, m)[::m]
            order = np.argsort(keys)
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[m] = (seen, keys[order], [(grams[i], found[grams[i]]) for i in order])

    def scan(self, texts: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, set[int], np.ndarray, np.ndarray]]:
        """Per text: words, which words are hit, items hit, and the words' places."""
        starts, ends, first = texts.words(WORD)
        hashes = texts.hashes(starts, ends)
        low = LOWER[texts.data]
        n = len(starts)
        cover = np.zeros(n + 1, np.int64)
        found: list[tuple[int, set[int]]] = []
        for m, (seen, keys, grams) in self.by_length.items():
            values = windows(hashes, m)
            for i in np.flatnonzero(seen[(values >> np.uint64(44)).astype(np.int64)]):
                doc = np.searchsorted(first, i, "right") - 1
                if i + m > first[doc + 1]:
                    continue
                k = int(np.searchsorted(keys, values[i]))
                while k < len(keys) and keys[k] == values[i]:
                    gram, items = grams[k]
                    if all(low[starts[i + j]:ends[i + j]].tobytes() == w for j, w in enumerate(gram)):
                        cover[i] += 1
                        cover[i + m] -= 1
                        found.append((int(doc), items))
                    k += 1
        hit = np.cumsum(cover[:n]) > 0
        items_of: dict[int, set[int]] = {}
        for doc, items in found:
            items_of.setdefault(doc, set()).update(items)
        for d in range(len(texts)):
            a, b = first[d], first[d + 1]
            yield d, hit[a:b], items_of.get(d, set()), starts[a:b] - texts.offsets[d], ends[a:b] - texts.offsets[d]


def _words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    texts = Texts(data, np.array([0, len(data)]))
    starts, ends, _ = texts.words(WORD)
    low = LOWER[data]
    return [low[a:b].tobytes() for a, b in zip(starts, ends)]


def ngram_blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[Ngrams]:
    """The benchmark as n-gram sets of at most ``block_bytes`` of text, an item each at least."""
    items, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        words = _words(row.text)
        size += sum(map(len, words))
        items.append((row.item_id, words))
        if size >= block_bytes:
            yield Ngrams(items, n)
            items, size = [], 0
    if items:
        yield Ngrams(items, n)


_SPAN = "struct<a:long,b:long,from:long,to:long>"
_HITS = f"id long, n_words long, spans array<{_SPAN}>, items array<string>"
_FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()),
                    ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in ("a", "b", "from", "to")]))),
                    ("items", pa.list_(pa.string()))])


def _runs(hit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)


def _cut(texts: Texts, d: int, bytes_of: list[tuple[int, int]]) -> str:
    """Text ``d`` without these runs of bytes."""
    raw = texts.data[texts.offsets[d]:texts.offsets[d + 1]].tobytes()
    ends = [0, *(int(x) for pair in bytes_of for x in pair), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2])).decode()


def _scanned(rows: DataFrame, block: Broadcast) -> DataFrame:
    """``id, n_words, spans, items`` per row of ``rows`` (id, text)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches):
            found: dict[str, list] = {f.name: [] for f in _FOUND}
            for _, hit, items, starts, ends in block.value.scan(texts):
                found["n_words"].append(len(hit))
                found["spans"].append([{"a": int(a), "b": int(b), "from": int(starts[a]), "to": int(ends[b - 1])} for a, b in _runs(hit)])
                found["items"].append(sorted({block.value.names[i] for i in items} - {None}))
            yield as_batch(found | {"id": batch.column(0)}, _FOUND)

    return rows.mapInArrow(scanned, _HITS)


def _first_two(benchmark: DataFrame, n: int, block_bytes: int) -> tuple[Ngrams, Iterator[Ngrams] | None]:
    """The first block and, where there are more, all blocks but the first."""
    blocks = ngram_blocks(benchmark, n, block_bytes)
    first, second = next(blocks, Ngrams([], n)), next(blocks, None)
    return first, None if second is None else itertools.chain([second], blocks)


def _by_blocks(rows: DataFrame, blocks: Iterator[Ngrams]) -> DataFrame:
    """What ``_scanned`` gives, from one pass per block over ``rows`` (id, text), whose ids differ."""
    spark = rows.sparkSession
    uri = new_folder(spark, "block-hits")
    for k, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(block)
        found = _scanned(rows, sent)
        (found if k == 0 else found.where(F.size("spans") > 0)).write.parquet(f"{uri}/block={k}")  # the first one has every row
        sent.destroy()
    hits = spark.read.schema(f"{_HITS}, block int").parquet(uri)
    order = Window.partitionBy("id").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("id", F.inline("spans")).withColumn("new", (F.col("a") > F.coalesce(before, F.lit(-1))).cast("int")) \
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("from").alias("from"), F.max("to").alias("to"))
    spans = runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "from", "to"))).alias("spans"))
    items = hits.select("id", F.explode("items").alias("item")).groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return hits.where("block = 0").select("id", "n_words").join(spans, "id", "left").join(items, "id", "left") \
        .select("id", "n_words", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, spans, items``.

    ``spans`` are the maximal runs of hit words as (first word, last word + 1, first
    byte, last byte + 1); ``items`` the distinct ids with occurring windows, as sorted strings.
    """
    first, more = _first_two(benchmark, n, block_bytes)
    rows = text_rows(docs)
    if more is None:
        return _scanned(rows, docs.sparkSession.sparkContext.broadcast(first)).withColumnRenamed("id", "doc_id")
    rows = saved(rows.withColumn("id", F.monotonically_increasing_id()), "numbered")
    found = _by_blocks(rows.select("id", "text"), itertools.chain([first], more))
    return rows.select("id", "doc_id").join(found, "id").drop("id")


def digests(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    return scan(docs, benchmark, n).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents",
            block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without contaminated documents, or without the hit spans; all columns stay.

    ``remove`` is ``"documents"`` or ``"spans"``. A span goes with its bytes; what
    stood before and after it is kept as it was.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    first, more = _first_two(benchmark, n, block_bytes)
    if more is None:
        return _cleaned(docs, docs.sparkSession.sparkContext.broadcast(first), remove)
    number, runs = free_names(docs, "_number", "_runs")
    rows = saved(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = _by_blocks(rows.select(F.col(number).alias("id"), whole_text().alias("text")), itertools.chain([first], more))
    hit = saved(found.where(F.size("spans") > 0).select(F.col("id").alias(number), F.transform(
        "spans", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))).alias(runs)), "hits")
    if remove == "documents":
        return rows.join(hit, number, "left_anti").drop(number)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(b for b in batches if b.num_rows):
            at, last = batch.schema.get_field_index("text"), batch.num_columns - 1
            new = [t if not spans else _cut(texts, d, [(s["from"], s["to"]) for s in spans])
                   for d, (t, spans) in enumerate(zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).select(list(range(last)))

    return rows.join(hit, number, "left").drop(number).mapInArrow(cut, docs.schema)


def _cleaned(docs: DataFrame, block: Broadcast, remove: str) -> DataFrame:

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(b for b in batches if b.num_rows):
            found = list(block.value.scan(texts))
            if remove == "documents":
                yield batch.filter(pa.array([not hit.any() for _, hit, _, _, _ in found]))
                continue
            at = batch.schema.get_field_index("text")
            new = batch.column(at).to_pylist()
            for d, hit, _, starts, ends in found:
                if hit.any():
                    new[d] = _cut(texts, d, [(starts[a], ends[b - 1]) for a, b in _runs(hit)])
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(judged, docs.schema)
