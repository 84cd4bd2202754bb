"""Exact copies by block naming, also where all blocks share one hash."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from doseloom.llm import exact

SCHEMA = "doc_id long, text string, block string, h string"


def fixture():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    rows = [(d, text(rng.randint(0, 60)), "b", "h") for d in range(60)]
    rows += [(100 + k, rows[k % 7][1], "other", None) for k in range(40)]
    rows += [(200, None, None, None), (201, "", None, None), (202, "x" * 5000, None, None), (203, "x" * 5000, None, None),
             (204, "x" * 4999 + "y", None, None), (205, "x" * 4999, None, None), (206, rows[0][1] + rows[1][1], None, None),
             (None, rows[2][1], None, None)]
    return rows


def expected(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t, *_ in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c).cast("long") % 2], ids=["hash", "collisions"])
def test_against_groups_of_equal_texts(spark, digest):
    rows = fixture()
    got = exact.duplicates(spark.createDataFrame(rows, SCHEMA), block_bytes=16, digest=digest).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_repeated_rows_and_ids_with_several_texts(spark):
    rows = [(1, "a", None, None), (1, "a", None, None), (1, "b", None, None), (2, "a", None, None), (None, "n", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact.duplicates(docs).collect())
    assert got == [(0, 0, 1, True), (1, 1, 1, True), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]
    kept = exact.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "n"), (1, "b"), (2, "a")]
    one = exact.without_duplicates(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert len(one) == 1


def test_clashing_columns(spark):
    rows = [(1, "a", "T", "K", 5, 6), (2, "a", "U", "L", 7, 8), (3, "b", "V", "M", 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tag string, _key string, _stay long, _stay_tag long")
    kept = exact.without_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[1:]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.duplicates(docs).count() == 0 and exact.without_duplicates(docs).count() == 0
