"""Token-id files: an adaptive context-mixing range coder in independent blocks.

A block is ``BLOCK`` ids with models and coder of its own. For each id three predictors speak:
order 2 (the id that last followed the two before it), order 1 (the one that last followed
the one before it) and the segment's commonest follower. The id is coded as who was right,
or as nobody; then order 0 says it: its class out of 16 by adaptive chances of the block, and
the id within the class by its count in the segment. The chances of the four cases come from three
adaptive tables, seen under contexts of order 0 to 2, mixed with weights that follow whichever table
predicts best. All arithmetic is on integers, so the decoder repeats it exactly.

Blocks don't depend on each other: each begins anew from its segment's start table (ids, counts,
commonest followers). Numpy codes the same place of many blocks at once; blocks are the lanes. A
segment is one row of the file: whole documents, their ids and lengths, the start table
and the blocks with a crc32 each. Segments are written in ascending ``doc_id`` order, ``part`` by
``part``, as Parquet rows, since that is what Spark writes on any store.

Defined results: null and empty texts are the end id alone; a null ``doc_id`` comes first and is
kept; repeated rows are written each; an empty table gives an empty file; columns other than
``doc_id`` and ``text`` are not read. A damaged block raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doseloom.llm.tables import as_batch, buckets, crc_of, text_rows
from doseloom.llm.text import portions
from doseloom.llm.tokens import encoder

MAGIC, VERSION = b"IDRC", 2
BLOCK = 2048
_HEAD = struct.Struct("<4sHHIIIQ")  # magic, version, flags, documents, blocks, bytes of the start table, ids
_NULL = -(1 << 63)
LIMIT = 1 << 20  # ids are below this
_SUCC, _GROUPS = 512, 16
_ONE = 1 << 15  # the four chances add up to this
_GAIN = 124  # of 4096, to the case that came; the first three stay below 4096 by it
_U = np.uint64
_LOW, _FIELD = _U(0xFFFFFFFF), _U(0xFFFF)
_FIELDS = 0x0001000100010001
_SURER = np.array([0, 0, 1, 2, 1, 2, 3, 3], np.int32)  # by right or wrong, then by sureness
# Cumulative chances of the classes, of 2 ** 14: even ones, and those that a class seen draws them to. Both
# rise by one at least from class to class, and so does whatever lies between them.
_EVEN = (np.arange(_GROUPS + 1) << 10).astype(np.int16)
_DRAWN = np.arange(_GROUPS + 1) + (np.arange(_GROUPS + 1) > np.arange(_GROUPS)[:, None]) * ((1 << 14) - _GROUPS)
_DRAWN = _DRAWN.astype(np.int16)
FILE_SCHEMA = "part int, segment int, n_ids long, payload binary"
_FILE = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class Start:
    """What every block of a segment begins with: the ids by falling count, their counts, and each id's
    commonest follower. Models speak of ranks in this order, in 16 classes of about equal counts.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, follower: np.ndarray):
        self.ids, self.counts, self.follower = ids.astype(np.int32), counts.astype(np.int64), follower.astype(np.int32)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.group = ((self.begins + self.counts // 2) * _GROUPS // max(int(self.counts.sum()), 1)).astype(np.int32)
        self.first = np.zeros(_GROUPS, np.int64)  # counts before a class
        sizes = np.bincount(self.group, self.counts, _GROUPS).astype(np.int64)
        self.first[1:] = np.cumsum(sizes)[:-1]
        self.total = np.maximum(sizes, 1).astype(_U)
        self.within = (self.begins - self.first[self.group]).astype(_U)
        self.size = self.counts.astype(_U)
        self.rank = np.full(int(self.ids.max(initial=-1)) + 1, -1, np.int32)
        self.rank[self.ids] = np.arange(len(self.ids))

    @classmethod
    def of(cls, ids: np.ndarray) -> Start:
        """From all ids of a segment."""
        if len(ids) and int(ids.max()) >= LIMIT:
            raise ValueError("ids must be below 2 ** 20")
        counts = np.bincount(ids.astype(np.int64))
        names = np.flatnonzero(counts)
        names = names[np.argsort(-counts[names], kind="stable")]
        place = np.zeros(len(counts), np.int64)
        place[names] = np.arange(len(names))
        ranks, n = place[ids], max(len(names), 1)
        pairs = np.sort(ranks[:-1] * n + ranks[1:])
        ends = np.flatnonzero(np.append(pairs[1:] != pairs[:-1], True)) if len(pairs) else np.zeros(0, np.int64)
        pairs = pairs[ends][np.argsort(np.diff(ends, prepend=-1), kind="stable")]
        follower = np.arange(len(names))
        follower[pairs // n] = pairs % n  # the most frequent is written last
        return cls(names, counts[names], follower)

    @classmethod
    def plain(cls) -> Start:
        """For blocks without a segment: any id below 2 ** 20, small ones likelier."""
        ids = np.arange(LIMIT)
        return cls(ids, 1 + (1 << 24) // (ids + 16), ids)

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (int(ids.max()) >= len(self.rank) or self.rank[ids].min() < 0):
            raise ValueError("ids must be below 2 ** 20 and stand in the start table")
        return self.rank[ids]

    def pack(self) -> bytes:
        return zlib.compress(np.concatenate([self.ids, self.counts, self.follower]).astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Start:
        return cls(*np.frombuffer(zlib.decompress(data), "<u4").reshape(3, -1))


class Models:
    """Predictors and adaptive tables of all lanes.

    A successor table's entry is ``rank * 4 + sureness``. The chances of the four cases in one context are
    four 16-bit fields of one word, so that a product or a shift works on all four.
    """

    def __init__(self, lanes: int, start: Start):
        self.start = start
        self.at = np.arange(lanes)
        self.at_next = self.at * _SUCC
        self.at_rows = self.at * 64, self.at * 16, self.at * 16
        self.next1, self.next2 = np.full(lanes * _SUCC, -4, np.int32), np.full(lanes * _SUCC, -4, np.int32)
        self.tables = [np.full(lanes * n, _U(_FIELDS << 10)) for n in (64, 16, 16)]
        self.weight = [np.full(lanes, 80) for _ in range(2)]
        self.last, self.before, self.case, self.case2 = (np.zeros(lanes, np.int64) for _ in range(4))
        self.groups = np.tile(_EVEN, (lanes, 1))

    def predict(self) -> np.ndarray:
        """Where each of the four cases begins, of ``_ONE``, by field."""
        mixed = self.last * 40503
        self.i1 = (mixed >> 5 & (_SUCC - 1)) + self.at_next
        self.i2 = (mixed + self.before * 10007 >> 4 & (_SUCC - 1)) + self.at_next
        one, two = self.next1.take(self.i1), self.next2.take(self.i2)
        self.p1, self.p2, self.s1, self.s2 = one >> 2, two >> 2, one & 3, two & 3
        self.p0 = self.start.follower.take(self.last)
        same = (self.p1 == self.p2) * np.int32(2) + (self.p1 == self.p0)
        rows = self.at_rows
        self.where = (rows[0] + (self.start.group.take(self.last) * 4 + self.case), rows[1] + (self.s1 * 4 + self.case),
                      rows[2] + (self.s2 * 4 + same))
        self.said = [t.take(i) for t, i in zip(self.tables, self.where)]
        w0, w1 = (w >> 5 for w in self.weight)
        self.mixed = self.said[0] * w0.view(_U) + self.said[1] * w1.view(_U) + self.said[2] * (8 - w0 - w1).view(_U)
        return self.mixed * _U(_FIELDS - 1) + _U(0x0003000200010000)

    def judge(self, row: np.ndarray) -> np.ndarray:
        """Case of the ranks that come next."""
        return np.where(row == self.p2, 0, np.where(row == self.p1, 1, 3 - (row == self.p0)))

    def ranks_of(self, case: np.ndarray) -> np.ndarray:
        return np.where(case == 0, self.p2, np.where(case == 1, self.p1, self.p0)).astype(np.int64)

    def learn(self, row: np.ndarray, case: np.ndarray) -> None:
        by = (case << 4).view(_U)
        mixed = (self.mixed >> by & _FIELD).view(np.int64) >> 3
        for k in range(2):
            gain = (self.said[k] >> by & _FIELD).view(np.int64) - mixed >> 6
            self.weight[k] = np.minimum(np.maximum(self.weight[k] + gain, 32), 112)
        gained = _U(_GAIN) << by
        for table, i, said in zip(self.tables, self.where, self.said):
            table[i] = said - (said >> _U(5) & _U(_FIELDS * 0x7F)) + gained
        for nxt, i, p, s in ((self.next1, self.i1, self.p1, self.s1), (self.next2, self.i2, self.p2, self.s2)):
            # Right: surer. Wrong: less sure, and replaced when it wasn't sure at all.
            held = p * 4 + _SURER.take((p == row) * np.int32(4) + s)
            nxt[i] = np.where((p == row) | (s > 0), held, row * 4)
        self.before, self.last = self.last, row
        self.case2, self.case = self.case, case


class Coder:
    """Range coder state of all lanes: 64-bit low and range, 32-bit words in and out.

    When the top words of the interval's ends agree, that word is settled. An interval
    that straddles a word border while it is short is cut at the border, so a
    settled word never changes.
    """

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, _U(0xFFFFFFFFFFFFFFFF))

    def narrow(self, unit: np.ndarray, begin: np.ndarray, size: np.ndarray, lanes: np.ndarray | None = None) -> None:
        """Take a part of the interval, in all lanes or in these."""
        if lanes is None:
            self.low += unit * begin
            self.range = unit * size
        else:
            self.low[lanes] += unit * begin
            self.range[lanes] = unit * size

    def settled(self, lanes: np.ndarray | None = None) -> np.ndarray:
        """The lanes (of all or of these) in which a word is settled."""
        low, size = (self.low, self.range) if lanes is None else (self.low.take(lanes), self.range.take(lanes))
        small = np.flatnonzero(size <= _LOW)
        if not len(small):
            # A long interval may hold a settled word too; it stays until the interval is short.
            return small
        places = small if lanes is None else lanes[small]
        low, size = low[small], size[small]
        crossed = (low & _LOW) + size > _U(1 << 32)
        self.range[places] = np.where(crossed, _U(1 << 32) - (low & _LOW), size)
        return places

    def shift(self, lanes: np.ndarray) -> None:
        self.low[lanes] <<= _U(32)
        self.range[lanes] <<= _U(32)


def _case_step(begins: np.ndarray, case: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = (case << 4).view(_U)
    begin = begins >> by & _FIELD
    return begin, ((begins >> _U(16) | _U(_ONE << 48)) >> by & _FIELD) - begin


def _group_step(drawn: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat, place = drawn.ravel(), np.arange(0, drawn.size, _GROUPS + 1) + group
    begin = flat.take(place)
    return begin.astype(_U), (flat.take(place + 1) - begin).astype(_U)


def encode_blocks(ids: np.ndarray, start: Start | None = None) -> list[bytes]:
    """The ids as coded blocks of ``BLOCK`` ids, each with its crc32 and number of ids in front."""
    lanes = -(-len(ids) // BLOCK)
    if not lanes:
        return []
    start = start or Start.plain()
    steps = min(BLOCK, len(ids))
    table = np.zeros(lanes * BLOCK, np.int32)
    table[:len(ids)] = start.ranks(ids)
    table = np.ascontiguousarray(table.reshape(lanes, BLOCK).T)
    models, coder = Models(lanes, start), Coder(lanes)
    words, used = np.zeros((lanes, steps * 2 + 8), "<u4"), np.zeros(lanes, np.int64)

    def out(settled: np.ndarray) -> None:
        if len(settled):
            words[settled, used[settled]] = coder.low[settled] >> _U(32)
            used[settled] += 1
            coder.shift(settled)

    for t in range(steps):
        row = table[t].astype(np.int64)
        begins = models.predict()
        case = models.judge(row)
        coder.narrow(coder.range >> _U(15), *_case_step(begins, case))
        free = np.flatnonzero(case == 3)
        if len(free):
            rank = row[free]
            group = start.group[rank]
            drawn = models.groups.take(free, 0)
            coder.narrow(coder.range[free] >> _U(14), *_group_step(drawn, group), free)
            models.groups[free] = drawn + (_DRAWN.take(group, 0) - drawn >> 5)
        out(coder.settled())
        if len(free):
            coder.narrow(coder.range[free] // start.total[group], start.within[rank], start.size[rank], free)
            out(coder.settled(free))
        models.learn(row, case)
    for _ in range(2):
        words[models.at, used] = coder.low >> _U(32)
        used += 1
        coder.low <<= _U(32)
    blocks = []
    for k in range(lanes):
        own = ids[k * BLOCK:(k + 1) * BLOCK]
        blocks.append(struct.pack("<II", crc_of(own), len(own)) + words[k, :used[k]].tobytes())
    return blocks


def decode_blocks(blocks: list[bytes], start: Start | None = None) -> np.ndarray:
    """The ids of coded blocks; raises where a block's checksum doesn't fit."""
    if not blocks:
        return np.zeros(0, np.uint32)
    start = start or Start.plain()
    heads = [struct.unpack_from("<II", b) for b in blocks]
    counts = np.array([n for _, n in heads])
    if counts.max() > BLOCK:
        raise ValueError("a block's length is damaged")
    lanes, steps = len(blocks), int(counts.max())
    longest = max(len(b) for b in blocks) // 4 + 4
    words = np.zeros((lanes, longest), "<u4")
    for k, b in enumerate(blocks):
        own = np.frombuffer(b, "<u4", (len(b) - 8) // 4, 8)
        words[k, :len(own)] = own
    models, coder = Models(lanes, start), Coder(lanes)
    code = words[:, 0].astype(_U) << _U(32) | words[:, 1].astype(_U)
    used = np.full(lanes, 2)
    table = np.zeros((steps, lanes), np.int32)

    def take(settled: np.ndarray) -> None:
        if len(settled):
            coder.shift(settled)
            code[settled] = code[settled] << _U(32) | words[settled, np.minimum(used[settled], longest - 1)]
            used[settled] += 1

    for t in range(steps):
        begins = models.predict()
        unit = coder.range >> _U(15)
        value = (code - coder.low) // unit
        case = (value >= (begins >> _U(16) & _FIELD)).astype(np.int64) + (value >= (begins >> _U(32) & _FIELD)) \
            + (value >= begins >> _U(48))
        coder.narrow(unit, *_case_step(begins, case))
        row = models.ranks_of(case)
        free = np.flatnonzero(case == 3)
        if len(free):
            drawn = models.groups.take(free, 0)
            unit = coder.range[free] >> _U(14)
            value = np.minimum((code[free] - coder.low[free]) // unit, _U((1 << 14) - 1)).astype(np.int16)
            below = np.bitwise_count((drawn[:, 1:] <= value[:, None]).view(_U))  # eight comparisons a word
            group = (below[:, 0] + below[:, 1]).astype(np.int64)
            coder.narrow(unit, *_group_step(drawn, group), free)
            models.groups[free] = drawn + (_DRAWN.take(group, 0) - drawn >> 5)
        take(coder.settled())
        if len(free):
            unit = coder.range[free] // start.total[group]
            value = np.minimum((code[free] - coder.low[free]) // unit, start.total[group] - _U(1)).astype(np.int64)
            rank = np.minimum(np.searchsorted(start.ends, value + start.first[group], "right"), len(start.ids) - 1)
            coder.narrow(unit, start.within[rank], start.size[rank], free)
            take(coder.settled(free))
            row[free] = rank
        row = np.maximum(row, 0)  # below 0 in damaged blocks and behind a block's end only
        table[t] = row
        models.learn(row, case)
    out = []
    for k, (crc, n) in enumerate(heads):
        own = start.ids[table[:n, k]].astype(np.uint32)
        if crc_of(own) != crc:
            raise ValueError(f"block {k}: its checksum doesn't fit")
        out.append(own)
    return np.concatenate(out)


def segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Whole documents as bytes: head, document table, block sizes, start table, crc32 of these, blocks."""
    start = Start.of(ids)
    blocks, packed = encode_blocks(ids, start), start.pack()
    table = _HEAD.pack(MAGIC, VERSION, 0, len(doc_ids), len(blocks), len(packed), len(ids)) \
        + np.array([_NULL if d is None else d for d in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes() \
        + np.array([len(b) for b in blocks], "<u4").tobytes() + packed
    return table + struct.pack("<I", zlib.crc32(table)) + b"".join(blocks)


def documents_of(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a segment."""
    magic, version, _, docs, blocks, packed, n = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    at = _HEAD.size + 16 * docs + 4 * blocks + packed
    if at + 4 > len(payload) or struct.unpack_from("<I", payload, at)[0] != zlib.crc32(payload[:at]):
        raise ValueError("a segment's table is damaged")
    names = np.frombuffer(payload, "<i8", docs, _HEAD.size)
    lengths = np.frombuffer(payload, "<i8", docs, _HEAD.size + 8 * docs)
    sizes = np.frombuffer(payload, "<u4", blocks, _HEAD.size + 16 * docs)
    ends = at + 4 + np.cumsum(sizes, dtype=np.int64)
    ids = decode_blocks([payload[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())], Start.unpack(payload[at - packed:at]))
    if len(ids) != n:
        raise ValueError("a segment's ids are not whole")
    return [None if d == _NULL else d for d in names.tolist()], lengths, ids


def write_ids(docs: DataFrame, uri: str, tokenizer: str, spaces: str = "kept", end_id: int = 0,
              segment_ids: int = 4_000_000) -> None:
    """Encode and write all documents below ``uri`` in ascending ``doc_id`` order.

    A segment closes after ``segment_ids`` ids, at the end of a document.
    """
    order = ["doc_id", F.xxhash64("text")]
    rows = text_rows(docs).repartitionByRange(buckets(docs.sparkSession, 1), *order).sortWithinPartitions(*order) \
        .withColumn("part", F.spark_partition_id())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        part, number, size = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            payload = segment(names, np.concatenate(lengths), np.concatenate(held))
            row = as_batch({"part": [part], "segment": [number], "n_ids": [size], "payload": [payload]}, _FILE)
            names.clear(), held.clear(), lengths.clear()
            number, size = number + 1, 0
            return row

        for batch, texts in portions(batches, 1 << 20):
            part = batch.column(2)[0].as_py()
            ids, first = encoder(tokenizer, spaces).encode(texts)
            ended = np.insert(ids, first[1:], np.uint32(end_id))
            names += batch.column(0).to_pylist()
            lengths.append(np.diff(first) + 1)
            held.append(ended)
            size += len(ended)
            if size >= segment_ids:
                yield close()
        if names:
            yield close()

    rows.mapInArrow(written, FILE_SCHEMA).write.parquet(uri)


def read_ids(spark: SparkSession, uri: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and its ``ids`` (null without ``with_ids``)."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(uri)
    sizes = rows.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = parts.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", "segment", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("ahead")) \
        .join(parts, "part").select("part", "segment", (F.col("begin") + F.col("ahead")).alias("begin"))
    schema = pa.schema([*_READ, ("ids", pa.list_(pa.int32()))])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, lengths, ids = documents_of(payload.as_py())
                ends = np.cumsum(lengths)
                parts = [ids[e - n:e] for n, e in zip(lengths.tolist(), ends.tolist())]
                for a in range(0, len(names), 500):
                    own = slice(a, a + 500)
                    yield as_batch({"doc_id": names[own], "start": (begin + ends - lengths)[own], "n_tokens": lengths[own],
                                    "ids_crc32": [crc_of(p) for p in parts[own]],
                                    "ids": [p.astype(np.int32) if with_ids else None for p in parts[own]]}, schema)

    return rows.join(begins, ["part", "segment"]).select("begin", "payload").mapInArrow(
        decoded, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
