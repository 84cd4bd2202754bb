"""Exact duplicates by block naming, in DataFrame operations only.

Each text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted
and numbered: the number is the block's name, and two blocks have one name only if
they hold the same bytes. Then neighbouring names are paired and the distinct pairs
are sorted and numbered again, until each document is down to one name, which
together with its number of blocks is its identity. No step compares hashes instead
of bytes: a hash only deals blocks to tasks, and where two blocks share one, they
are told apart by their bytes.

Defined results: null text is the empty text (one empty block); a null ``doc_id`` is
an id of its own that is less than all others; rows that repeat an id and text are
one document with several rows, and ``group_size`` counts rows; an id that comes
with several texts is one document per text; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseloom.llm.tables import free_names, saved, text_rows, whole_text

Digest = Callable[[Column], Column]


def _rows(docs: DataFrame, block_bytes: int) -> DataFrame:
    body = text_rows(docs).select("doc_id", F.col("text").cast("binary").alias("body"))
    return body.select("doc_id", F.xxhash64("body").alias("tag"), "body",
                       F.greatest(F.lit(1), F.ceil(F.length("body") / block_bytes)).cast("int").alias("blocks"))


def _cut(rows: DataFrame, block_bytes: int, digest: Digest) -> DataFrame:
    """One row per block: document, place, bytes and the hash that deals it."""
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    cut = rows.select("doc_id", "tag", "blocks", F.posexplode(parts).alias("idx", "block"))
    return cut.withColumn("h", digest(F.col("block")))


def _numbered(distinct_rows: DataFrame, *order: str) -> DataFrame:
    """Sort each task's distinct rows and number them: partition number, then place."""
    return distinct_rows.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _same_document(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    b = b.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"),
                 *[c for c in b.columns if c not in ("doc_id", "tag")])
    return a.join(b, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_id")), how).drop("_id", "_tag")


def identities(docs: DataFrame, block_bytes: int = 4096, digest: Digest = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, tag, blocks, name, text_sha256``.

    ``(blocks, name)`` is equal for two rows exactly when their texts are equal.
    """
    cut = _cut(_rows(docs, block_bytes), block_bytes, digest)
    # Few distinct blocks share a hash, so a set is one block long; hot blocks meet in the partial sets.
    sets = cut.groupBy("h").agg(F.collect_set("block").alias("set"))
    named = sets.select("h", (F.size("set") > 1).alias("shared"), F.explode(F.array_sort("set")).alias("block"))
    names = saved(_numbered(named, "h", "block").select(
        "h", F.when(F.col("shared"), F.col("block")).alias("block"), "name"), "block-names")
    places = cut.select("doc_id", "tag", "blocks", "idx", "h")
    level = places.join(names.where("block is null").select("h", "name"), "h").drop("h")
    shared = names.where("block is not null")
    if not shared.isEmpty():  # two blocks met in one hash: their bytes decide
        level = level.unionByName(
            cut.join(shared.withColumnRenamed("block", "_block").withColumnRenamed("h", "_h"),
                     (F.col("h") == F.col("_h")) & (F.col("block") == F.col("_block")))
            .select(*level.columns))
    level = saved(level.withColumn("left", F.col("blocks")), "named-blocks")
    done = level.where("left = 1")
    depth = level.agg(F.max("left")).first()[0] or 1
    while depth > 1:
        pairs = level.where("left > 1").groupBy(
            "doc_id", "tag", "blocks", "left", (F.col("idx") / 2).cast("int").alias("idx")) \
            .agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = saved(pairs, "block-pairs")
        names = saved(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
        level = saved(pairs.join(names, ["a", "b"]).select(
            "doc_id", "tag", "blocks", "idx", "name", F.ceil(F.col("left") / 2).cast("int").alias("left")), "named-pairs")
        done = done.unionByName(level.where("left = 1"), allowMissingColumns=True)
        depth = (depth + 1) // 2
    done = done.select("doc_id", "tag", "blocks", "name").distinct()
    rows = _rows(docs, block_bytes).select("doc_id", "tag", F.sha2("body", 256).alias("text_sha256"))
    return _same_document(rows, done)


def duplicates(docs: DataFrame, block_bytes: int = 4096, digest: Digest = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays.
    """
    marked = saved(identities(docs, block_bytes, digest), "identities")
    groups = marked.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = saved(groups, "copy-groups")
    return marked.join(groups, ["blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the row with the largest ``doc_id``.

    Of rows that repeat a kept id and text any one stays.
    """
    marked = saved(identities(docs, block_bytes), "identities")
    best = marked.groupBy("blocks", "name").agg(F.max("doc_id").alias("_keep"))
    stay = marked.join(saved(best, "copy-groups"), ["blocks", "name"]).where(F.col("doc_id").eqNullSafe(F.col("_keep")))
    stay = saved(stay.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("rows")), "stay")
    tag, key, stay_id, stay_tag = free_names(docs, "_tag", "_key", "_stay", "_stay_tag")
    tagged = docs.withColumns({tag: F.xxhash64(whole_text().cast("binary")), key: F.col("doc_id").cast("long")})
    ids = stay.select(F.col("doc_id").alias(stay_id), F.col("tag").alias(stay_tag))
    kept = tagged.join(ids, (F.col(tag) == F.col(stay_tag)) & F.col(key).eqNullSafe(F.col(stay_id)), "left_semi")
    if not stay.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates([key, tag])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
