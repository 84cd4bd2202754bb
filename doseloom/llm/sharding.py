"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws.

Every node of the tree draws a number for the document's id; the draw is
``-ln(u) / weight`` with u uniform from a hash of id and node, and the smallest draw
wins. A document descends from the root, so a changed weight moves documents only
into or out of that node's subtree: the draws of all other nodes stay as they were.

Defined results: the id alone decides, so null text, empty and very long texts change
only ``size`` and ``text_crc32``; a null ``doc_id`` has a place of its own like any
id; repeated rows share a shard and get slots one after the other; an empty table
gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseloom.llm.tables import buckets, text_rows

Racks = Mapping[str, Sequence[tuple[int, float]]]
#: region name -> rack name -> (shard number, weight)
Tree = Mapping[str, Racks]


def tree_of(shards: int, grown: int = 0, racks: int = 4, per_rack: int = 2) -> Tree:
    """``shards`` shards of weight 1 in regions of ``racks`` racks, and ``grown`` more.

    Each added shard opens a region of its own, so it takes documents only into itself.
    """
    tree: dict[str, dict[str, list[tuple[int, float]]]] = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", []).append((s, 1.0))
    for s in range(shards, shards + grown):
        tree[f"added{s}"] = {f"rack-added{s}": [(s, 1.0)]}
    return tree


def _nodes(level: Mapping[str, tuple[float, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), inner.alias("inner"))
                     for n, (w, inner) in sorted(level.items()) if w > 0])


def _winner(key: Column, nodes: Column) -> Column:
    """What the node with the smallest draw holds; the first in name order on a tie."""
    def drawn(node: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, node["name"]), 11).cast("double")
        draw = -F.log((bits + 0.5) / float(1 << 53)) / node["weight"]
        return F.struct(draw.alias("draw"), node["name"].alias("name"), node["inner"].alias("inner"))
    return F.array_min(F.transform(nodes, drawn))["inner"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard a key descends to: the winning region's winning rack's winning shard."""
    regions = {}
    for region, racks in tree.items():
        inner = {rack: (sum(w for _, w in shards), _nodes({f"shard{s}": (w, F.lit(s)) for s, w in shards}))
                 for rack, shards in racks.items()}
        regions[region] = (sum(w for w, _ in inner.values()), _nodes(inner))
    return _winner(key, _winner(key, _winner(key, _nodes(regions))))


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """One row per row: ``doc_id, size, text_crc32, shard, grown_shard`` and ``slot``.

    Slots count from 0 without gaps in each shard, in the order of a hash of the id.
    Each shard is numbered in slices of that hash, and a slice begins where the
    counts of the slices before it end, so no task holds a whole shard.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = F.col("text").cast("binary")
    placed = text_rows(docs).select(
        "doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets(spark, 1))).cast("int").alias("slice"))
    ahead = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n")) \
        .select("shard", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("place", F.row_number().over(within) - 1) \
        .join(begins, ["shard", "slice"]) \
        .select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("place")).cast("long").alias("slot"),
                "grown_shard")
