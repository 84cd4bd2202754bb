"""Passages that repeat across documents, found with enhanced suffix arrays.

A passage of ``min_bytes`` bytes that stands in two documents has the same smallest
k-gram hash (its key) in both. So the work can be dealt without losing a match:

0. of texts that are equal as a whole, only the document with the least id takes part: the
   others repeat it from end to end;
1. each portion of the documents lists the keys of its windows of ``min_bytes`` bytes;
2. per key bucket, keys that reach two documents are told back to their portions, with those
   whose windows make more than ``hot`` strings (summed over the portions);
3. a portion cuts each run of windows that share such a key into one string and sends
   every distinct string once, with the least document that holds it and whether there are several;
4. per key bucket, the suffixes of these strings are sorted, the common prefixes of
   neighbours give the interval tree in one stack scan, and every interval of at least
   ``min_bytes`` whose occurrences differ in the byte before them (else a longer
   passage covers it) is a maximal repeat group;
5. the groups go back to the portions, which find all occurrences in their texts.

The texts are shuffled once: Spark reuses that exchange for steps 1, 3 and 5. A key
with more than ``hot`` strings is cut into single windows, dealt by their own
hash, so no key brings its contexts together in one task; a string or window goes out
once per portion however often it stands there. Both ways give the same spans. Where
groups are named, windows would name pieces of a passage, so keys stay whole there.

On the way back a string is named by a 64-bit digest of its bytes, and the crc32 of the bytes
must agree as well before a place is marked.

Defined results: null text is the empty text; texts shorter than ``min_bytes`` match
nothing; a null ``doc_id`` counts as greater than all others; rows that repeat an id are
one document to each other, so neither loses bytes to the other; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are not read. A removal may cut a UTF-8
character: bytes are what the contract counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.llm.tables import buckets, saved, text_rows
from doseloom.llm.text import U, Texts, _power, mix, portions

_NO_ID = np.iinfo(np.int64).max
def _rows(**kinds) -> tuple[pa.Schema, str]:
    """An Arrow schema and its DDL."""
    names = {int: (pa.int32(), "int"), bytes: (pa.binary(), "binary")}
    return (pa.schema([(k, names[v][0]) for k, v in kinds.items()]), ", ".join(f"{k} {names[v][1]}" for k, v in kinds.items()))


_KEYS, _SQL_KEYS = _rows(bucket=int, portion=int, keys=bytes, several=bytes, strings=bytes)
_HITS, _SQL_HITS = _rows(portion=int, keys=bytes, hot=bytes, copies=bytes)
_STRINGS, _SQL_STRINGS = _rows(bucket=int, portion=int, keys=bytes, low=bytes, several=bytes, sizes=bytes, bytes=bytes, hot=bytes)
_GROUPS, _SQL_GROUPS = _rows(portion=int, groups=bytes, hot=bytes, copies=bytes)
_COPY = np.dtype([("doc_id", "<i8"), ("tag", "<i8"), ("first", "<i8")])
_GROUP = np.dtype([("name", "<u8"), ("group", "<u8"), ("parent", "<u8"), ("first", "<i8"), ("at", "<u4"), ("size", "<u4"),
                   ("check", "<u4")])
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                   ("groups", pa.list_(pa.struct([("group", pa.int64()), ("parent", pa.int64()), ("start", pa.int64()),
                                                  ("length", pa.int64()), ("first_doc", pa.int64())]))),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                   ("kept_sha256", pa.string())])
_SQL_DOCS = ("doc_id long, n_bytes long, groups array<struct<group:long,parent:long,start:long,length:long,first_doc:long>>, "
             "spans array<struct<start:long,end:long>>, kept_sha256 string")
_HOT = 20_000
_RUN = 64  # windows in one string at most, for texts that repeat one k-gram without end


class Runs:
    """Runs of consecutive windows with one key, over some texts."""

    def __init__(self, texts: Texts, min_bytes: int, gram: int):
        data, n = texts.data, len(texts.data)
        self.texts, self.total = texts, np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _power(n, "up"), out=self.total[1:])
        none = np.zeros(0, np.int64)
        self.start, self.count, self.key, self.doc = none, none, none.astype(U), none
        if n < min_bytes:
            return
        least = mix((self.total[gram:] - self.total[:-gram]) * _power(n - gram + 1, "down"))
        width, span = 1, min_bytes - gram + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        valid = np.zeros(len(least), bool)  # windows that end inside their text
        for a, b in zip(texts.offsets[:-1], texts.offsets[1:]):
            valid[a:max(a, b - min_bytes + 1)] = True
        begin = valid.copy()
        begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        starts = texts.offsets[:-1]
        starts = starts[starts < len(begin)]
        begin[starts] = valid[starts]
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(least))
        gaps = np.cumsum(valid)
        count = gaps[stop - 1] - gaps[start] + 1
        if len(count) and count.max() > _RUN:
            pieces = -(-count // _RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, left = np.repeat(start, pieces) + nth * _RUN, np.repeat(count, pieces) - nth * _RUN
            count = np.minimum(left, _RUN)
        self.start, self.count, self.key = start, count, least[start]
        self.doc = np.searchsorted(texts.offsets, start, "right") - 1

    def only(self, keep: np.ndarray) -> Runs:
        self.start, self.count, self.key, self.doc = self.start[keep], self.count[keep], self.key[keep], self.doc[keep]
        return self

    def singled(self, hot: np.ndarray) -> Runs:
        """Runs with a hot key as single windows."""
        split = np.isin(self.key, hot) if len(hot) else np.zeros(len(self.key), bool)
        self.hot = np.repeat(split, np.where(split, self.count, 1))
        if split.any():
            times = np.where(split, self.count, 1)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            self.start, self.key = np.repeat(self.start, times) + nth, np.repeat(self.key, times)
            self.count, self.doc = np.where(self.hot, 1, np.repeat(self.count, times)), np.repeat(self.doc, times)
        return self

    def names(self, min_bytes: int) -> np.ndarray:
        """Digest of each run's bytes."""
        end = self.start + self.count + min_bytes - 1
        size = (end - self.start).astype(U)
        return mix((self.total[end] - self.total[self.start]) * _power(len(self.total), "down")[self.start] + size)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _dealt(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _least(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with their least low, greatest high and number of rows."""
    if not len(keys):
        return keys, low, high, np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys, low, high = keys[order], low[order], high[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.diff(np.append(at, len(keys)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def interval_groups(lcp: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray,
                    least: int) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """Stack scan of a common-prefix array: (first, last, depth, low, high, diverse) of each
    interval of depth ``least`` or more.

    ``low`` and ``high`` are each suffix's least and greatest document, ``before`` the byte
    before it, negative where it differs among the places the suffix stands for.
    """
    n = len(lcp)
    i = 1
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    ends = deep[np.flatnonzero(np.diff(np.append(deep, n + 2)) > 1)]
    firsts = deep[np.flatnonzero(np.diff(np.concatenate([[-2], deep])) > 1)] - 1
    for a, b in zip(firsts.tolist(), ends.tolist()):
        depths, lows = lcp[a:b + 1].tolist(), low[a:b + 1].tolist()
        highs, lefts = high[a:b + 1].tolist(), before[a:b + 1].tolist()
        stack: list[list] = []  # depth, first, low, high, byte before (-1: differs)
        for i in range(1, b - a + 2):
            depth = depths[i] if i <= b - a else 0
            leaf = [0, i - 1, lows[i - 1], highs[i - 1], lefts[i - 1]]
            while stack and stack[-1][0] > depth:
                top = stack.pop()
                _take(top, leaf)
                yield a + top[1], a + i - 1, top[0], top[2], top[3], top[4] < 0
                leaf = top.copy()
            if stack and stack[-1][0] == depth:
                _take(stack[-1], leaf)
            elif depth >= least:
                leaf[0] = depth
                stack.append(leaf)


def _take(interval: list, other: list) -> None:
    interval[1] = min(interval[1], other[1])
    interval[2] = min(interval[2], other[2])
    interval[3] = max(interval[3], other[3])
    if interval[4] != other[4]:
        interval[4] = -1


def _digest(string: bytes) -> int:
    return int.from_bytes(hashlib.sha256(string).digest()[:8], "big") or 1


def suffix_groups(strings: list[bytes], low: np.ndarray, high: np.ndarray, min_bytes: int,
                  every: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Maximal repeat groups of distinct strings that may share passages.

    The rows (string number, and group, parent, first document, at, size) list each
    occurrence with its deepest group and with every group around it, at most one per window of a
    string; without ``every`` only with those that reach an earlier document than the ones inside.
    A group's ``parent`` is the next group around it, 0 if there is none.
    """
    sizes = np.array([len(s) for s in strings])
    longest = int(sizes.max())
    buffer = np.frombuffer(b"".join(strings) + bytes(longest), np.uint8)
    begin = np.cumsum(sizes) - sizes
    per = sizes - min_bytes + 1
    string = np.repeat(np.arange(len(strings)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    size = sizes[string] - at
    rows = np.lib.stride_tricks.sliding_window_view(buffer, longest)[begin[string] + at]
    rows[np.arange(longest)[None, :] >= size[:, None]] = 0
    order = np.argsort(rows.view(f"S{longest}").ravel(), kind="stable")
    rows, string, at, size = rows[order], string[order], at[order], size[order]
    lcp = np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), longest)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
    del rows, differ
    place = begin[string] + at
    before = np.where(at > 0, buffer[place - 1].astype(np.int64), -1)
    found = [x for x in interval_groups(lcp, low[string], high[string], before, min_bytes) if x[5] and x[3] < x[4]]
    # A string that several documents hold is itself a group: the leaf of its first suffix.
    leaves = np.flatnonzero((at == 0) & (low[string] < high[string]))
    found += [(k, k, n, f, f + 1, True) for k, n, f in zip(leaves.tolist(), size[leaves].tolist(), low[string[leaves]].tolist())]
    found.sort(key=lambda x: (x[0], -x[1], x[2]))  # groups around others come first
    owner = np.full(len(string), -1)
    kept, parent, digest = [], [], []
    for a, b, depth, first, *_ in found:
        if owner[a] >= 0 and kept[owner[a]][0] == depth:
            continue  # a leaf as long as the group around it: the same passage
        parent.append(int(owner[a]))
        digest.append(_digest(buffer[place[a]:place[a] + depth].tobytes()))
        owner[a:b + 1] = len(kept)
        kept.append((depth, first))
    numbers, out = [], []
    at_once = np.flatnonzero(owner >= 0)
    around, digest = np.array([*parent, -1]), np.array([*digest, 0], U)
    depth, first = np.array([x[0] for x in kept] + [0]), np.array([x[1] for x in kept] + [0], np.int64)
    now, told = owner[at_once], np.full(len(at_once), np.iinfo(np.int64).max)
    while len(at_once):
        tell = (first[now] < told) | every
        own, group = at_once[tell], now[tell]
        part = np.zeros(len(own), _GROUP)
        part["group"], part["parent"], part["first"] = digest[group], digest[around[group]], first[group]
        part["at"], part["size"] = at[own], depth[group]
        numbers.append(string[own])
        out.append(part)
        told, now = np.minimum(told, first[now]), around[now]
        at_once, told, now = at_once[now >= 0], told[now >= 0], now[now >= 0]
    return (np.concatenate(numbers), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, _GROUP))


def _whole(strings: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of strings that share no window with another: those that several documents hold."""
    own = np.flatnonzero(low < high)
    part = np.zeros(len(own), _GROUP)
    part["group"], part["first"] = [_digest(strings[k]) for k in own], low[own]
    part["size"] = [len(strings[k]) for k in own]
    return own, part


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blobs: list[bytes], sizes: list[int]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(blobs, sizes)]
    return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(np.int64)


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def _copies(base: DataFrame, min_bytes: int) -> DataFrame:
    """Per portion, the rows whose whole text also stands in a document with a smaller id, with the least such id."""
    info = saved(base.where(F.octet_length("text") >= min_bytes).where("doc_id is not null")
                 .select("portion", "doc_id", "tag", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "texts")
    first = info.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = info.join(saved(first, "first-texts"), "sha").where("doc_id > first")
    return saved(later.groupBy("portion").agg(F.array_sort(F.collect_set(F.struct("doc_id", "tag", "first"))).alias("c"))
                 .select("portion", F.col("c.doc_id").alias("doc_id"), F.col("c.tag").alias("tag"), F.col("c.first").alias("first")),
                 "copies")


def _copy_rows(table: pa.Table) -> dict[tuple[int, int], int]:
    """(doc_id, tag) of each copy in a portion, and the least document with its text."""
    rows = _joined(table, "copies", _COPY) if table.num_rows else np.zeros(0, _COPY)
    return {(d, t): f for d, t, f in rows.tolist()}


def _texts_of_portion(table: pa.Table, copies: dict) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The portion's rows without the copies."""
    if copies:
        pairs = zip(table.column("doc_id").to_pylist(), table.column("tag").to_pylist())
        table = table.filter(pa.array([p not in copies for p in pairs], pa.bool_()))
    return portions(table.to_batches(), 1 << 21)


def _based(docs: DataFrame, n: int) -> DataFrame:
    return text_rows(docs).select("doc_id", "text", F.xxhash64("text").alias("tag"),
                                  F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("portion"))


def _copy_hits(base: DataFrame, min_bytes: int) -> DataFrame:
    def packed(table: pa.Table) -> pa.Table:
        rows = np.zeros(len(table.column("doc_id")[0]), _COPY)
        for name in _COPY.names:
            rows[name] = table.column(name)[0].values.to_numpy()
        return _table([{"portion": table.column("portion")[0].as_py(), "keys": b"", "hot": b"", "copies": rows.tobytes()}], _HITS)

    return _copies(base, min_bytes).groupBy("portion").applyInArrow(packed, _SQL_HITS)


def shared_keys(base: DataFrame, copies: DataFrame, n: int, min_bytes: int = 50, gram: int = 24, hot: int = _HOT) -> DataFrame:
    """Per portion and bucket, the keys that reach two documents, and which of them have more than ``hot`` strings."""
    def listed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _KEYS)
        portion = left.column("portion")[0].as_py()
        keys, low, names = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
        for batch, texts in _texts_of_portion(left, _copy_rows(right)):
            runs = Runs(texts, min_bytes, gram)
            keys.append(runs.key)
            low.append(_ids(batch)[runs.doc])
            names.append(runs.names(min_bytes))
        ids, each = np.concatenate(low), np.concatenate(keys)
        keys, least, most, _ = _least(each, ids, ids)
        own = np.sort(each[np.unique(np.concatenate(names), return_index=True)[1]])  # the key of each distinct string
        strings = np.diff(np.append(np.searchsorted(own, keys), len(own))).astype("<u4")
        order, cut = _dealt((keys % U(n)).astype(np.int64), n)
        keys, several, strings = keys[order], (least < most)[order], strings[order]
        return _table([{"bucket": b, "portion": portion, "keys": keys[x:y].tobytes(), "several": _bits(several[x:y]),
                        "strings": strings[x:y].tobytes()}
                       for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x], _KEYS)

    def shared(table: pa.Table) -> pa.Table:
        places = table.column("portion").to_pylist()
        lists = [np.frombuffer(k, U) for k in table.column("keys").to_pylist()]
        flag = _flags(table.column("several").to_pylist(), [len(k) for k in lists])
        each = np.concatenate(lists)
        keys, _, most, count = _least(each, flag, flag)
        strings = np.bincount(np.searchsorted(keys, each), _joined(table, "strings", "<u4"), len(keys))
        again = (count > 1) | (most > 0)
        keys, busy = keys[again], keys[again & (strings > hot)]
        out = []
        for place, have in zip(places, lists):
            hits = have[_among(keys, have)]
            if len(hits):
                out.append({"portion": place, "keys": hits.tobytes(), "hot": np.intersect1d(hits, busy).tobytes(), "copies": b""})
        return _table(out, _HITS)

    keys = base.groupBy("portion").cogroup(copies.groupBy("portion")).applyInArrow(listed, _SQL_KEYS)
    return keys.groupBy("bucket").applyInArrow(shared, _SQL_HITS)


def repeats(docs: DataFrame, min_bytes: int = 50, gram: int = 24, hot: int = _HOT, windows_at_once: int = 250_000,
            with_groups: bool = True, name_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, groups, spans, kept_sha256``.

    ``groups`` are the occurrences of maximal repeat groups (group, the group around it, start,
    length, first document), as ``suffix_groups`` lists them; a copy of a whole text has
    that text as its group. Without ``with_groups`` they stay unnamed, which saves shuffling names.
    ``spans`` are the maximal byte ranges covered by strings of ``min_bytes`` bytes that also
    stand in a document with a smaller id; ``kept_sha256`` is of the other bytes. ``name_bits`` of a
    string's digest name it on the way back; fewer bring strings of one name, told apart by their crc32.
    """
    spark, bits = docs.sparkSession, U((1 << name_bits) - 1)
    n = buckets(spark, 1)
    base = _based(docs, n)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _table([], _STRINGS)
        portion = left.column("portion")[0].as_py()
        hits, busy = np.sort(_joined(right, "keys", "<u8")), _joined(right, "hot", "<u8")
        seen: dict[bytes, list] = {}  # string -> key, least document, whether there are several
        for batch, texts in _texts_of_portion(left, _copy_rows(right)):
            ids, runs = _ids(batch), Runs(texts, min_bytes, gram)
            runs = runs.only(_among(hits, runs.key)).singled(busy)
            data, names = texts.data.tobytes(), runs.names(min_bytes)
            keys = np.where(runs.hot, names, runs.key)
            ends = runs.start + runs.count + min_bytes - 1
            for a, b, key, doc in zip(runs.start.tolist(), ends.tolist(), keys.tolist(), ids[runs.doc].tolist()):
                string = data[a:b]
                have = seen.get(string)
                if have is None:
                    seen[string] = [key, doc, False]
                elif doc != have[1]:
                    have[1], have[2] = min(doc, have[1]), True
        strings, facts = list(seen), list(seen.values())
        keys, low = np.array([f[0] for f in facts], U), np.array([f[1] for f in facts], np.int64)
        several = np.array([f[2] for f in facts], bool)
        order, cuts = _dealt((keys % U(n)).astype(np.int64), n)
        short = (keys // U(n)).astype(np.uint32)  # keys only bring strings together; a shared one does no harm
        empty = dict.fromkeys(("keys", "low", "several", "sizes", "bytes", "hot"), b"")
        out = [{"bucket": portion, "portion": portion, **empty, "hot": busy.tobytes()}] if len(busy) else []
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y > x:
                own = order[x:y]
                parts = [strings[k] for k in own.tolist()]
                out.append({"bucket": b, "portion": portion, "keys": short[own].tobytes(), "low": low[own].tobytes(),
                            "several": _bits(several[own]), "sizes": np.array([len(p) for p in parts], "<u2").tobytes(),
                            "bytes": b"".join(parts), "hot": b""})
        return _table(out, _STRINGS)

    def grouped(table: pa.Table) -> pa.Table:
        counts = [len(x) // 2 for x in table.column("sizes").to_pylist()]
        sizes, keys = _joined(table, "sizes", "<u2").astype(np.int64), _joined(table, "keys", "<u4")
        low = _joined(table, "low", "<i8")
        high = low + _flags(table.column("several").to_pylist(), counts)
        place = np.repeat(np.array(table.column("portion").to_pylist()), counts)
        raw = b"".join(table.column("bytes").to_pylist())
        told = [{"portion": p, "groups": b"", "hot": h, "copies": b""} for p, h in
                zip(table.column("portion").to_pylist(), table.column("hot").to_pylist()) if h]
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(keys, kind="stable")
        load = np.cumsum((sizes - min_bytes + 1)[order])
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        places, out = [], []
        a = 0
        while a < len(order):  # some keys at a time, each key whole
            b = max(int(np.searchsorted(load, (load[a - 1] if a else 0) + windows_at_once, "right")), a + 1)
            while b < len(order) and not new[b]:
                b += 1
            own = order[a:b]
            a = b
            ids: dict[bytes, int] = {}
            which = np.array([ids.setdefault(raw[begin[k]:begin[k] + sizes[k]], len(ids)) for k in own.tolist()])
            strings = list(ids)
            least, most, key = np.full(len(ids), _NO_ID), np.full(len(ids), np.iinfo(np.int64).min), np.zeros(len(ids), np.uint32)
            np.minimum.at(least, which, low[own])
            np.maximum.at(most, which, high[own])
            key[which] = keys[own]
            _, back, among = np.unique(key, return_inverse=True, return_counts=True)
            alone = among[back] == 1  # no other string has this key, so none shares a window
            found = []
            for part, groups in ((np.flatnonzero(alone), _whole), (np.flatnonzero(~alone), None)):
                if len(part):
                    some = [strings[k] for k in part.tolist()]
                    number, rows = groups(some, least[part], most[part]) if groups else \
                        suffix_groups(some, least[part], most[part], min_bytes, with_groups)
                    found.append((part[number], rows))
            string, rows = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            if not with_groups:
                rows["group"], rows["parent"] = 0, 0
            lengths = np.array([len(x) for x in strings])
            data = np.frombuffer(b"".join(strings), np.uint8)
            runs = Runs.__new__(Runs)
            runs.total = np.zeros(len(data) + 1, U)
            np.cumsum((data.astype(U) + U(1)) * _power(len(data), "up"), out=runs.total[1:])
            runs.start, runs.count = np.cumsum(lengths) - lengths, lengths - min_bytes + 1
            rows["name"] = runs.names(min_bytes)[string] & bits
            told_of, back = np.unique(string, return_inverse=True)
            rows["check"] = np.array([zlib.crc32(strings[k]) for k in told_of.tolist()], np.uint32)[back]
            by = np.argsort(string, kind="stable")
            rows, string = rows[by], string[by]
            lo, hi = np.searchsorted(string, which), np.searchsorted(string, which, "right")
            have = np.flatnonzero(hi > lo)
            times = (hi - lo)[have]
            pick = np.repeat(lo[have], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            # What a portion's own documents start is of use to it only as a group.
            rows, spots = rows[pick], np.repeat(place[own][have], times)
            useful = np.ones(len(rows), bool) if with_groups else rows["first"] < np.repeat(high[own][have], times)
            places.append(spots[useful])
            out.append(rows[useful])
        if not out:
            return _table(told, _GROUPS)
        places, rows = np.concatenate(places), np.concatenate(out)
        order, cuts = _dealt(places, n)
        return _table(told + [{"portion": p, "groups": rows[order[x:y]].tobytes(), "hot": b"", "copies": b""}
                              for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x], _GROUPS)

    def marked(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _DOCS)
        rows = np.sort(_joined(right, "groups", _GROUP), order="name") if right.num_rows else np.zeros(0, _GROUP)
        new = np.ones(len(rows), bool)
        new[1:] = rows["name"][1:] != rows["name"][:-1]
        first = np.flatnonzero(new)
        names, upto = rows["name"][first], np.append(first[1:], len(rows))
        busy = _joined(right, "hot", "<u8") if right.num_rows else np.zeros(0, U)
        copies = _copy_rows(right)
        out = []
        for batch, texts in portions(left.to_batches(), 1 << 21):
            ids = _ids(batch)
            tags = batch.column(batch.schema.get_field_index("tag")).to_pylist()
            found: list[list] = [[] for _ in range(len(texts))]
            data = texts.data
            if len(names):
                runs = Runs(texts, min_bytes, gram).singled(busy)
                ends = runs.start + runs.count + min_bytes - 1
                called = runs.names(min_bytes) & bits
                at = np.searchsorted(names, called)
                at[at == len(names)] = 0
                for k in np.flatnonzero(names[at] == called).tolist():
                    d = int(runs.doc[k])
                    place = int(runs.start[k] - texts.offsets[d])
                    check = zlib.crc32(data[runs.start[k]:ends[k]])
                    for row in rows[first[at[k]]:upto[at[k]]].tolist():
                        if row[6] == check:
                            found[d].append((row[1], row[2], place + row[4], row[5], row[3]))
            for d in range(len(texts)):
                a, b, doc = int(texts.offsets[d]), int(texts.offsets[d + 1]), int(ids[d])
                raw, spans = data[a:b].tobytes(), []
                whole = copies.get((doc, tags[d]))
                if whole is not None:
                    found[d] = [(_digest(raw) if with_groups else 0, 0, 0, b - a, whole)]
                for start, end in sorted((x, x + size) for _, _, x, size, least in found[d] if least < doc):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([start, end])
                cuts = [0, *(x for y in spans for x in y), b - a]
                kept = hashlib.sha256(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2]))).hexdigest()
                groups = sorted(set(found[d]), key=lambda g: (g[2], g[3], g[0])) if with_groups else []
                out.append({"doc_id": None if doc == _NO_ID else doc, "n_bytes": b - a, "kept_sha256": kept,
                            "spans": [{"start": x, "end": y} for x, y in spans],
                            "groups": [{"group": _signed(g), "parent": _signed(p) if p else None, "start": x, "length": size,
                                        "first_doc": None if f == _NO_ID else f} for g, p, x, size, f in groups]})
        return _table(out, _DOCS)

    copies = _copy_hits(base, min_bytes)
    most = np.iinfo(np.int64).max if with_groups else hot
    hits = shared_keys(base, copies, n, min_bytes, gram, most).unionByName(copies)
    strings = base.groupBy("portion").cogroup(hits.groupBy("portion")).applyInArrow(cut, _SQL_STRINGS)
    groups = strings.groupBy("bucket").applyInArrow(grouped, _SQL_GROUPS) \
        .unionByName(copies.select("portion", F.col("keys").alias("groups"), "hot", "copies"))
    return base.groupBy("portion").cogroup(groups.groupBy("portion")).applyInArrow(marked, _SQL_DOCS)


def digests(docs: DataFrame, min_bytes: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return repeats(docs, min_bytes, with_groups=False).select("doc_id", "n_bytes", removed.alias("n_removed"),
                                           F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
