"""Near-duplicate classes against all pairs of full shingle sets."""

import random
import re

import pytest

from pyspark.sql import functions as F

from doseloom.llm import neardup

SCHEMA = "doc_id long, text string, lang string, label string"


def brute(rows, n=3, percent=85):
    sets = {}
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else \
            ({tuple(words)} if words else set())
    label = {d: d for d in sets}
    def root(d):
        while label[d] != d:
            d = label[d]
        return d
    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in docs)


def fixture():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "the", "of"]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    rows, d = [], 0
    for _ in range(25):
        base = text(rng.randint(1, 150))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((d, " ".join(copy), "en", "x"))
            d += 7
            base = copy if rng.random() < 0.5 else base  # chains: ends are less alike than neighbours
    boiler = text(60)
    for _ in range(30):
        rows.append((d, " ".join(text(20) + boiler + text(20)), None, None))
        d += 1
    rows += [(d + 1, None, None, None), (d + 2, "", None, None), (d + 3, " \n", None, None), (d + 4, "Two\twords", None, None),
             (d + 5, "two words", None, None), (d + 6, rows[0][1].upper(), None, None), (d + 7, "w1 " * 5000, None, None)]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = fixture()
    got = neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(4, "a b c d e", None, None), (4, "a b c d e", None, None), (None, "a b c d e", None, None), (2, "a b c d e", None, None)]
    got = neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (2, 2, True), (4, 2, False), (4, 2, False)]


def test_an_id_with_several_texts_is_a_document_for_each(spark):
    a, b, near = "one two three four five six seven", "quite another text that nobody copies here", "quite another text that nobody copies here too"
    rows = [(1, a, None, None), (5, a, None, None), (5, b, None, None), (7, near, None, None), (7, a, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = neardup.classes(docs, percent=80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 1, False), (7, 5, False)]
    kept = neardup.without_near_copies(docs, shingle=3).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (5, b)]


def test_clashing_columns_of_the_stage(spark):
    rows = [(1, "a b c d e f", 3, 4, 5), (2, "a b c d e f", 3, 4, 5), (9, None, 3, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _gone_tag long, TAG long")
    kept = neardup.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_stage_keeps_one_of_each_group(spark):
    rows = fixture()
    kept = neardup.without_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "label"]
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, c, k in brute(rows, 5, 80) if k]


def test_empty_table(spark):
    assert neardup.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unwanted_texts_are_not_shuffled(spark):
    """The bitmap of ids drops texts where they are read; what is left is joined exactly, with null, negative and repeated ids."""
    rows = spark.range(-500, 20_000).select(F.when(F.col("id") % 1000 == 3, None).otherwise(F.col("id") * 7919).alias("doc_id"), F.lit("x").alias("text"))
    rows = rows.unionByName(rows.limit(50))
    ids = rows.where("doc_id % 41 = 0").select("doc_id").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neardup.rows_of(rows, ids)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(ids, "doc_id", "left_semi").collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "Join Inner" in joins[0] and "Join LeftSemi" in joins[1] and "bitmapBucketNumber" in joins[1]
