"""The registered queries on the smallest tables, each against a plain version."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import oracle_check
from tests.llm import test_decontaminate, test_neardup, test_pii, test_repeats

public_tokenizers = pytest.importorskip("public_tokenizers")
QUERIES = entry.queries()


def named(n):
    return next(k for k in QUERIES if k.startswith(f"op{n}_"))


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def rows(spark, sf, n):
    return QUERIES[named(n)](spark, sf).collect()


def tokenizer(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("n,column,threshold", [(1, "quality", 0.3), (8, "toxic", 0.5)])
def test_scores(spark, sf, texts, n, column, threshold):
    known = dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{sf}/labels.parquet'").fetchall())
    got = rows(spark, sf, n)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.doc_id in known and r.held_out]
    assert sum(r.predicted == known[r.doc_id] for r in unseen) >= 0.8 * len(unseen) > 10


def test_pieces(spark, sf, texts):
    encode, found = tokenizer("word_bpe_49k.json"), {}
    got = rows(spark, sf, 2)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == found.get(r.doc_id, 0)
        found[r.doc_id] = r.start + r.length
        ids = (encode.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1])
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert sorted(found) == sorted(texts)
    at = 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == at and r.offset + r.length <= 2048
        at += r.length


def test_id_files(spark, sf, texts):
    encode, start = tokenizer("byte_bpe_50k.json"), 0
    got = {r.doc_id: r for r in rows(spark, sf, 3)}
    for d in sorted(texts):
        ids = encode.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_exact_copies(spark, sf):
    con = oracle_check.connect(sf)
    assert oracle_check.compare(QUERIES[named(4)](spark, sf), con, entry.oracle_sql()[named(4)]) is None


def test_shards(spark, sf, texts):
    got, slots = rows(spark, sf, 5), {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_benchmark_windows(spark, sf, texts):
    items = [(str(i), t) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()]
    assert sorted(map(tuple, rows(spark, sf, 6)), key=str) == test_decontaminate.expected(list(texts.items()), items)


def test_repeated_passages(spark, sf, texts):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, sf, 7))
    assert got == test_repeats.removed(sorted(texts.items()))


def test_near_copies(spark, sf, texts):
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows(spark, sf, 9))
    assert got == test_neardup.brute(list(texts.items()))


def test_personal_data(spark, sf, texts):
    got = {r.doc_id: r for r in rows(spark, sf, 10)}
    assert sorted(got) == sorted(texts)
    for d, text in texts.items():
        found = test_pii.base(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
        assert got[d].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        places = [int(m) for m in re.findall(r":(\d+):", got[d].spans)]
        assert places == sorted(places) and set(filter(None, listed.split(","))) <= set(got[d].spans.split(","))


@pytest.mark.parametrize("n", [11, 12, 13])
def test_against_sql(spark, sf, n):
    con = oracle_check.connect(sf)
    assert oracle_check.compare(QUERIES[named(n)](spark, sf), con, entry.oracle_sql()[named(n)]) is None
