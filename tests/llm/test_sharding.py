"""The hash tree: near even, movement confined, slots without gaps."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from doseloom.llm import sharding

SCHEMA = "doc_id long, text string, size string, slot string"


def moved(spark, before, after, n=20000):
    rows = spark.range(n).select(sharding.shard_of(F.col("id").cast("string"), before).alias("a"),
                                 sharding.shard_of(F.col("id").cast("string"), after).alias("b")).collect()
    return [(r.a, r.b) for r in rows]


def test_an_added_shard_takes_rows_only_into_itself(spark):
    pairs = moved(spark, sharding.tree_of(40), sharding.tree_of(40, grown=1))
    counts = Counter(a for a, _ in pairs)
    assert set(counts) == set(range(40)) and max(counts.values()) < 1.3 * 500 and min(counts.values()) > 0.7 * 500
    assert all(b in (a, 40) for a, b in pairs)
    assert 0.7 * 20000 / 41 < sum(b == 40 for _, b in pairs) < 1.3 * 20000 / 41


def test_a_changed_weight_moves_rows_only_into_or_out_of_its_subtree(spark):
    tree = {"east": {"r0": [(0, 1.0), (1, 1.0)], "r1": [(2, 1.0)]}, "west": {"r2": [(3, 2.0), (4, 1.0)]}}
    heavier = {"east": tree["east"], "west": {"r2": [(3, 2.0), (4, 3.0)]}}
    for a, b in moved(spark, tree, heavier):
        assert a == b or b in (3, 4)
    share = Counter(a for a, _ in moved(spark, tree, tree))
    assert abs(share[3] / 20000 - 2 / 6) < 0.03
    drained = {"east": tree["east"], "west": {"r2": [(3, 2.0), (4, 0.0)]}}
    assert all(b != 4 for _, b in moved(spark, tree, drained))


def test_slots_sizes_and_checksums(spark):
    rows = [(d, "é" * (d % 7) if d % 5 else None, "s", "t") for d in range(3000)] + [(7, "again", None, None)] * 3 + [(None, "n", None, None)]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA), sharding.tree_of(40), sharding.tree_of(40, grown=1)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    texts = {(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t, *_ in rows}
    assert {(r.doc_id, r.text_crc32, r.size) for r in got} == texts


def test_empty_table(spark):
    assert sharding.assign(spark.createDataFrame([], SCHEMA), sharding.tree_of(40)).count() == 0
