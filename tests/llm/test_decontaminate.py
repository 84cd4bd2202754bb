"""Benchmark windows against a plain scan over words."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from doseloom.llm import decontaminate, text

SCHEMA = "doc_id long, text string, items string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(rows, items, n=10):
    out = []
    for d, text, *_ in rows:
        own, hit, names = words(text), set(), set()
        for name, t in items:
            w = words(t)
            m = min(n, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for j in range(len(own) - m + 1):
                    if own[j:j + m] == w[i:i + m]:
                        hit.update(range(j, j + m))
                        names.add(name)
        names = sorted(x for x in names if x is not None)
        out.append((d, len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(4)
    vocabulary = ["the", "on", "Énd", "rat", "42", "of"] + [f"w{k}" for k in range(30)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(f"q{k}", text(rng.randint(10, 25))) for k in range(12)] + [
        ("short", "w1 w2 rat"), ("same", "w1 w2, RAT"), ("none", "?!"), ("null", None), (None, "w3 w4 w5"), ("q0", "twice q0 zz")]
    rows = []
    for d in range(200):
        parts = [text(rng.randint(0, 30))]
        if d % 3 == 0:
            w = rng.choice(items[:12])[1].split()
            a = rng.randint(0, max(0, len(w) - 10))
            parts += ["--" + ", ".join(w[a:a + rng.randint(8, 15)]).upper() + "!", text(5)]
        rows.append((d, " ".join(parts), "x"))
    rows += [(900, None, None), (901, "", None), (902, "...", None), (903, "w1 w2 rat " * 3000, None), (904, "w1 w2 rat", None),
             (904, "w1 w2 rat", None), (None, "a w1 w2 rat", None)]
    return rows, items


@pytest.mark.parametrize("block_bytes", [8 << 20, 1])
def test_against_plain_scan(spark, block_bytes):
    rows, items = fixture()
    docs, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.digests(docs, benchmark).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, items)
    many = decontaminate.scan(docs, benchmark, block_bytes=block_bytes).collect()
    one = decontaminate.scan(docs, benchmark).collect()
    assert sorted(map(str, many)) == sorted(map(str, one))
    kept = decontaminate.cleaned(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(e[0]) for e in expected(rows, items) if not e[5])
    cut = decontaminate.cleaned(docs, benchmark, remove="spans", block_bytes=block_bytes)
    assert cut.columns == docs.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, decontaminate.cleaned(docs, benchmark, remove="spans").collect()))


def test_spans_go_with_their_bytes(spark):
    docs = spark.createDataFrame([(1, "Before É! alpha BETA gamma. After", None)], SCHEMA)
    benchmark = spark.createDataFrame([("q", "alpha beta gamma")], "item_id string, text string")
    assert decontaminate.cleaned(docs, benchmark, remove="spans").first().text == "Before É! . After"


def test_empty_tables(spark):
    rows, items = fixture()
    none = spark.createDataFrame([], "item_id string, text string")
    got = decontaminate.digests(spark.createDataFrame(rows, SCHEMA), none).collect()
    assert len(got) == len(rows) and not any(r.contaminated for r in got)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate.digests(spark.createDataFrame([], SCHEMA), benchmark).count() == 0
    assert decontaminate.cleaned(spark.createDataFrame(rows, SCHEMA), none).count() == len(rows)


def test_a_scan_holds_little_beside_a_large_batch():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 600)) for _ in range(2000)]
    grams = decontaminate.Ngrams([("one", decontaminate._words(texts[7])[:30])], 10)
    batch = pa.record_batch({"doc_id": pa.array(range(2000)), "text": pa.array(texts)})
    text._powers.update(up=np.ones(1, text.U), down=np.ones(1, text.U))
    tracemalloc.start()
    hits = [hit.sum() for _, t in text.portions([batch]) for _, hit, _, _, _ in grams.scan(t)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hits) == 2000 and hits[7] == 30 and sum(hits) == 30
    assert peak < 90e6, peak  # 6.5 MB of text
