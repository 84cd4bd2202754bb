"""Near duplicates by an inverted join of MinHash signature coordinates.

A document's set is its distinct word shingles; its signature holds the least value of
``K`` hash functions over that set. Each (coordinate, value) pair is a posting list of
documents, and two documents collide once for each coordinate they share.

* Copies are one class: documents with the same word sequence are judged once.
* Skip: a document with fewer than ``match`` coordinates that anyone else has can't reach
  ``match`` collisions, so it posts nothing. Prefix: a document posts its ``K - match + 1`` rarest
  coordinates only, those that nobody shares counted in. Two documents with ``match`` collisions have one
  of them in common, and what most documents have is posted last. The collisions of a pair that
  meets there are counted over whole signatures.
* First each document meets only its lists' leaders, a pair per posting. Pairs with ``match``
  collisions or more are confirmed or refuted on their full shingle sets, with whole-number
  arithmetic, and the links make components.
* A pair inside a component can't change it, so from then on only lists with several
  components matter, and in these only pairs across components. They are never listed: blocks of
  such a list are compared with each other inside the tasks, each pair in its first common list,
  by collisions, then by a longer signature, then on full sets; only links come out. This
  looks at every pair across components that meets in a list, so no further round is needed.

``match`` lies six standard deviations below what a pair at the threshold shares, and the
longer signature's bound as well: such a pair is missed with a probability under 1e-6, at 0.85 as
at 0.8; every reported link is exact. Documents that are nearly, but not quite, similar enough
have to be told apart pair by pair: that part grows with the square of a group of such
documents, and is spread over blocks.

Defined results: null and empty texts have no set, are linked with nothing and stay; an id
that comes with several texts is a document for each of them, linked, reported and removed by
its own text; a null ``doc_id`` is linked with nothing and stays; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not read, and ``without_near_copies`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseloom.llm.tables import as_batch, buckets, free_names, saved, text_rows, whole_text
from doseloom.llm.text import LOWER, U, Texts, distinct, mix, portions, windows

K = 64
LONG = 512  # coordinates of the longer signature, a byte each
ID_BITS = 26  # of the bitmap of ids: 8 MB, however many ids there are
_LEAST_BLOCK, _MOST_BLOCK = 1024, 4096  # documents of a list's block; a pair of the smaller ones takes under a second
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
_SEEDS, _ODD = (mix(np.arange(1, K + LONG + 1, dtype=U) * U(c)) >> U(32) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_SEEDS, _ODD = _SEEDS.astype(np.uint32), _ODD.astype(np.uint32) | np.uint32(1)
_INFO = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("signature", pa.binary())])
_LISTS = pa.schema([("bucket", pa.int32()), ("portion", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])
_COUNTS = pa.schema([("portion", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])
_POSTED = pa.schema([("doc", pa.int64()), ("token", pa.int64()), ("place", pa.int32()), ("posted", pa.int64())])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("cls", pa.binary()), ("long", pa.binary())])
_NEAR = pa.schema([("token", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("doc", pa.int64()), ("pairs", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: Texts, n: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Per text: sorted distinct shingle hashes and a digest of its words."""
    starts, ends, first = texts.words(WORD)
    words = texts.hashes(starts, ends)
    every = windows(words, n)
    for d in range(len(texts)):
        a, b = int(first[d]), int(first[d + 1])
        if a == b:
            yield np.zeros(0, U), b""
            continue
        digest = hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest()
        yield (distinct(every[a:b - n + 1]) if b - a >= n else windows(words[a:b], b - a)), digest


def least_match(coordinates: int, percent: int) -> int:
    """Six standard deviations below the coordinates that a pair at the threshold shares."""
    share = percent / 100
    return int(coordinates * share - 6 * (coordinates * share * (1 - share)) ** 0.5)


def _least_values(shingles: np.ndarray, first: int, last: int) -> np.ndarray:
    x = (shingles >> U(32)).astype(np.uint32)
    least = np.full(last - first, np.uint32(0xFFFFFFFF))
    step = max(1, (1 << 18) // (last - first))
    for a in range(0, len(x), step):
        h = (x[a:a + step][None, :] ^ _SEEDS[first:last, None]) * _ODD[first:last, None]
        h ^= h >> np.uint32(15)
        np.minimum(least, h.min(1), out=least)
    return least


def signatures(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, tag, n_shingles, cls, signature`` per row; ``tag`` is a hash of the text; no class or signature without words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches):
            sizes, classes, marks = [], [], []
            for shingles, digest in shingle_sets(texts, shingle):
                sizes.append(len(shingles))
                classes.append(digest or None)
                marks.append(_least_values(shingles, 0, K).tobytes() if len(shingles) else None)
            yield as_batch({"doc_id": batch.column(0), "tag": batch.column(2), "n_shingles": sizes, "cls": classes, "signature": marks}, _INFO)

    return text_rows(docs).withColumn("tag", F.xxhash64("text")) \
        .mapInArrow(made, "doc_id long, tag long, n_shingles long, cls binary, signature binary")


def postings(reps: DataFrame, match: int) -> DataFrame:
    """``doc, token, place, posted``: the lists of each document's rarest coordinates, as far as others share them.

    ``posted`` has a bit for each coordinate that the document posts.

    The documents are dealt to portions. A portion sends each of its tokens once, with a
    count, and gets back how many documents have it, so a token that a third of all
    documents share is a row per portion and never a row per document.
    """
    n = buckets(reps.sparkSession, 1)
    base = reps.select(F.col("rep").alias("doc"), "signature",
                       F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int").alias("portion"))

    def tokens_of(table: pa.Table) -> np.ndarray:
        marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, K)
        return mix((np.arange(K, dtype=U) << U(32))[None, :] | marks.astype(U))

    def listed(table: pa.Table) -> pa.Table:
        tokens = np.sort(tokens_of(table).ravel())
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        tokens, counts = tokens[at], np.diff(np.append(at, len(tokens)))
        bucket = (tokens % U(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(n + 1))
        own = [order[x:y] for x, y in zip(cut[:-1], cut[1:])]
        have = [b for b in range(n) if len(own[b])]
        return pa.table({"bucket": have, "portion": [table.column("portion")[0].as_py()] * len(have),
                         "tokens": [tokens[own[b]].tobytes() for b in have],
                         "counts": [counts[own[b]].tobytes() for b in have]}, schema=_LISTS)

    def counted(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(t, U) for t in table.column("tokens").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()])
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        keys, counts = every[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, df = keys[at], np.add.reduceat(counts, at)
        keys, df = keys[df > 1], df[df > 1]
        out: dict[str, list] = {"portion": [], "tokens": [], "counts": []}
        for place, have in zip(table.column("portion").to_pylist(), lists):
            k = np.searchsorted(keys, have)
            k[k == len(keys)] = 0
            hit = keys[k] == have if len(keys) else np.zeros(len(have), bool)
            if hit.any():
                out["portion"].append(place)
                out["tokens"].append(have[hit].tobytes())
                out["counts"].append(df[k[hit]].tobytes())
        return pa.table(out, schema=_COUNTS)

    def prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        if not left.num_rows or not right.num_rows:
            return pa.table([empty, empty, empty.astype(np.int32), empty], schema=_POSTED)
        keys = np.frombuffer(b"".join(right.column("tokens").to_pylist()), U)
        df = np.frombuffer(b"".join(right.column("counts").to_pylist()), np.int64)
        order = np.argsort(keys)
        keys, df = keys[order], df[order]
        tokens = tokens_of(left)
        at = np.searchsorted(keys, tokens)
        at[at == len(keys)] = 0
        many = np.where(keys[at] == tokens, df[at], 1)
        # One order for all documents: by how many have a coordinate, then by its name.
        rarest = np.lexsort((tokens, many), axis=1)[:, :K - match + 1]
        chosen = np.zeros(tokens.shape, bool)
        np.put_along_axis(chosen, rarest, True, 1)
        chosen &= (many > 1) & ((many > 1).sum(1) >= match)[:, None]
        row, place = np.nonzero(chosen)
        docs, bits = left.column("doc").to_numpy(), np.packbits(chosen, 1, "little").view("<i8").ravel()
        return pa.table([docs[row], tokens[row, place].view(np.int64), place.astype(np.int32), bits[row]], schema=_POSTED)

    lists = base.groupBy("portion").applyInArrow(listed, "bucket int, portion int, tokens binary, counts binary")
    shared = lists.groupBy("bucket").applyInArrow(counted, "portion int, tokens binary, counts binary")
    return base.groupBy("portion").cogroup(shared.groupBy("portion")).applyInArrow(
        prefixes, "doc long, token long, place int, posted long")


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is one of the ``ids``, which are distinct.

    A broadcast bitmap of hashed ids, of bounded size, drops nearly all others where they are read, so that the join
    shuffles the wanted texts instead of all. It never drops a wanted row, and the join decides.
    """
    def place() -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))

    marks = ids.groupBy(F.bitmap_bucket_number(place()).alias("_bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place())).alias("_bits"))
    bit = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (F.bitmap_bucket_number(place()) == F.col("_bucket")) & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return rows.join(F.broadcast(marks), marked, "left_semi").join(ids, "doc_id")  # no semi join, which would be moved below the first


def confirmed(pairs: DataFrame, marks: DataFrame, sets: DataFrame, match: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, among those whose signatures agree."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, K) for i in (2, 3))
            yield batch.filter(pa.array((x == y).sum(1) >= match)).select(["a", "b"])

    one, two = (marks.select(F.col("rep").alias(k), F.col("signature").alias(f"s{k}")) for k in "ab")
    near = saved(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long"),
                 "alike")
    one, two = (sets.select(F.col("doc").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    return near.join(one, "a").join(two, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                                                     common.alias("common")) \
        .where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def _forest(links: np.ndarray) -> np.ndarray:
    """Links that connect the same documents as all of them do, fewer than there are documents."""
    above: dict[int, int] = {}

    def top(d: int) -> int:
        while (up := above.setdefault(d, d)) != d:
            above[d] = d = above.setdefault(up, up)
        return d

    keep = []
    for k, (a, b) in enumerate(links.tolist()):
        a, b = top(a), top(b)
        if a != b:
            above[b] = a
            keep.append(k)
    return links[keep]


def across(posted: DataFrame, labels: DataFrame, marks: DataFrame, sets: DataFrame, match: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all documents that share a list, are in different components and are similar enough.

    A list is cut into blocks by a hash of the document; a task gets two blocks of one list. It
    looks at all their pairs and returns as many links as connect what it found.
    """
    spark = posted.sparkSession
    lists = saved(posted.join(labels, "doc", "left")
                  .select("token", "place", "doc", "posted", F.coalesce("label", "doc").alias("label")), "labelled-lists")
    sizes = lists.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    spread = max(1, round((buckets(spark, 1) / 4) ** 0.5))  # block pairs for the tasks of a quarter of the partitions
    mixed = sizes.groupBy("token").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels"),
                                       F.sum("n").alias("n")).where("labels > 1") \
        .select("token", F.col("top.label").alias("top"),
                F.greatest(F.ceil(F.col("n") / _MOST_BLOCK), F.least(F.ceil(F.col("n") / _LEAST_BLOCK), F.lit(spread))).cast("int").alias("blocks"))
    mixed = saved(mixed, "mixed-lists")
    facts = marks.select(F.col("rep").alias("doc"), "signature").join(sets.select("doc", "long"), "doc")
    rows = lists.join(mixed, "token").join(facts, "doc") \
        .withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")) \
        .select("token", "place", "doc", "posted", (F.col("label") != F.col("top")).alias("outside"), "label", "signature", "long", "block",
                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    least_long = least_match(LONG, percent)

    def compare(table: pa.Table) -> pa.Table:
        """Pairs of two blocks that collide often enough, and the documents they need."""
        col = {c: table.column(c).to_numpy() for c in ("doc", "label", "block", "outside")}
        short = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, K)
        long = np.frombuffer(b"".join(table.column("long").to_pylist()), np.uint8).reshape(-1, LONG)
        posted = np.unpackbits(table.column("posted").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") > 0
        token, i, j, place = (table.column(c)[0].as_py() for c in ("token", "i", "j", "place"))
        left, right = np.flatnonzero(col["block"] == i), np.flatnonzero(col["block"] == j)
        found = [np.zeros((0, 2), np.int64)]
        for a in left.tolist():
            rest = right if i != j else right[col["doc"][right] > col["doc"][a]]
            rest = rest[(col["label"][rest] != col["label"][a]) & (col["outside"][rest] | col["outside"][a])]
            if place:  # an earlier list has looked at those that meet there
                rest = rest[~((short[rest, :place] == short[a, :place]) & posted[rest, :place] & posted[a, :place]).any(1)]
            rest = rest[(short[rest] == short[a]).sum(1, dtype=np.uint8) >= match]
            rest = rest[(long[rest] == long[a]).sum(1, dtype=np.uint16) >= least_long]
            if len(rest):
                found.append(np.stack([np.full(len(rest), col["doc"][a]), col["doc"][rest]], 1))
        pairs = np.concatenate(found)
        if not len(pairs):
            return _NEAR.empty_table()
        docs = distinct(pairs.ravel())
        n = len(docs) + 1
        return pa.table([np.full(n, token), np.full(n, i, np.int32), np.full(n, j, np.int32),
                         pa.array([*docs.tolist(), None], pa.int64()), pa.array([None] * len(docs) + [pairs.tobytes()], pa.binary())],
                        schema=_NEAR)

    def judge(table: pa.Table) -> pa.Table:
        """The pairs whose full sets are similar enough."""
        pairs = np.frombuffer(b"".join(p for p in table.column("pairs").to_pylist() if p), np.int64).reshape(-1, 2)
        have = dict(zip(table.column("doc").to_pylist(), table.column("shingles")))
        have = {d: v.values.to_numpy() for d, v in have.items() if d is not None}
        links = [np.zeros((0, 2), np.int64)]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])) if len(pairs) else []
        for x, y in zip(starts, [*starts[1:], len(pairs)]):
            one = np.sort(have[pairs[x, 0]])
            for z in range(x, y, 256):
                others = [have[d] for d in pairs[z:min(z + 256, y), 1].tolist()]
                lengths = np.array([len(o) for o in others])
                flat = np.concatenate(others)
                at = np.searchsorted(one, flat)
                at[at == len(one)] = 0
                common = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(lengths) - lengths)
                links.append(pairs[z:min(z + 256, y)][100 * common >= percent * (len(one) + lengths - common)])
        links = _forest(np.concatenate(links))
        return pa.table([links.min(1), links.max(1)] if len(links) else [links[:, 0], links[:, 1]], schema=_LINKS)

    near = saved(rows.groupBy("token", "i", "j").applyInArrow(compare, "token long, i int, j int, doc long, pairs binary"), "near-blocks")
    whole = near.where("doc is not null").join(sets.select("doc", "shingles"), "doc") \
        .select("token", "i", "j", "doc", F.lit(None).cast("binary").alias("pairs"), "shingles") \
        .unionByName(near.where("doc is null").withColumn("shingles", F.lit(None).cast("array<long>")))
    return whole.groupBy("token", "i", "j").applyInArrow(judge, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``doc, label``: the least document each linked one reaches.

    Every document takes the least label among its neighbours, then the label of that
    label; links are rewritten to join labels, so the number of rounds grows with the
    logarithm of a chain's length.
    """
    labels = saved(links.select(F.col("a").alias("doc")).union(links.select("b")).distinct()
                   .withColumn("label", F.col("doc")), "labels")
    edges = links
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("label"), F.least("a", "m").alias("to"))
        least = saved(least, "least")
        hop = least.select(F.col("label").alias("to"), F.col("to").alias("far"))
        least = saved(least.join(hop, "to", "left").select("label", F.coalesce("far", "to").alias("to")), "hops")
        labels = saved(labels.join(least, "label", "left")
                       .select("doc", F.coalesce("to", "label").alias("label")), "labels")
        one, two = (least.select(F.col("label").alias(k), F.col("to").alias(f"t{k}")) for k in "ab")
        edges = saved(edges.join(one, "a").join(two, "b").where("ta <> tb")
                      .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def classes(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    return _classified(docs, shingle, percent).drop("tag")


def _classified(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The same with the ``tag`` of each row's text."""
    match = least_match(K, percent)
    info = saved(signatures(docs, shingle), "signatures")
    # A class is one word sequence under a number of its own; its least id is where its text is read again.
    heads = info.where("cls is not null and doc_id is not null").groupBy("cls") \
        .agg(F.min(F.struct("doc_id", "signature")).alias("least")).select("cls", "least.doc_id", "least.signature")
    reps = saved(heads.withColumn("rep", F.monotonically_increasing_id()), "class-heads")
    posted = saved(postings(reps, match), "postings")
    involved = posted.select("doc").distinct()
    marks = saved(reps.join(involved.withColumnRenamed("doc", "rep"), "rep", "left_semi").select("rep", "cls", "doc_id", "signature"),
                  "marks")
    named = marks.select("doc_id", F.col("rep").alias("doc"), "cls")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches):
            rows = [(d, s, c) for d, (s, c) in zip(batch.column(0).to_pylist(), shingle_sets(texts, shingle)) if c]
            yield as_batch({"doc_id": [r[0] for r in rows], "shingles": [r[1].view(np.int64) for r in rows], "cls": [r[2] for r in rows],
                            "long": [_least_values(r[1], K, K + LONG).astype(np.uint8).tobytes() for r in rows]}, _SETS)

    texts = text_rows(docs)
    wanted = rows_of(texts, marks.select("doc_id").distinct()) \
        .mapInArrow(listed, "doc_id long, shingles array<long>, cls binary, long binary")
    sets = saved(wanted.join(named, ["doc_id", "cls"]).dropDuplicates(["doc"]).select("doc", "shingles", "long"), "sets")

    leaders = posted.groupBy("token").agg(F.min("doc").alias("a"))
    meet = posted.join(saved(leaders, "leaders"), "token").where("doc <> a").select("a", F.col("doc").alias("b")).distinct()
    links = saved(confirmed(meet, marks, sets, match, percent), "links")
    more = saved(across(posted, components(links), marks, sets, match, percent), "links")
    labels = components(links.unionByName(more))
    placed = saved(reps.join(labels.withColumnRenamed("doc", "rep"), "rep", "left")
                   .select("cls", "doc_id", F.coalesce("label", "rep").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = placed.join(least, "component").select(F.col("cls").alias("_cls"), "component_id")
    linked = F.col("doc_id").isNotNull()
    out = info.join(own, F.col("cls") == F.col("_cls"), "left") \
        .withColumn("component_id", F.coalesce(F.when(linked, F.col("component_id")), "doc_id"))
    return out.select("doc_id", "tag", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each group the document with the least id.

    A row goes by its id and text, so another text under the same id is judged by itself.
    """
    gone_id, gone_tag = free_names(docs, "_gone", "_gone_tag")
    gone = saved(_classified(docs, shingle, percent).where("not kept")
                 .select(F.col("doc_id").alias(gone_id), F.col("tag").alias(gone_tag)).distinct(), "near-copies")
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64(whole_text()) == F.col(gone_tag)), "left_anti")
