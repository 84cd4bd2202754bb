"""Exact round trips of the id files."""

import random
import zlib

import numpy as np
import pytest

from doseloom.llm import rangecoder
from doseloom.llm.rangecoder import BLOCK, Start, decode_blocks, documents_of, encode_blocks, segment

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_ids string"


@pytest.mark.parametrize("kind", ["random", "zipf", "constant", "cycle", "large", "one", "none"])
def test_blocks_come_back(kind):
    rng = np.random.default_rng(4)
    n = 3 * BLOCK + 77
    ids = {"random": rng.integers(0, 50_257, n), "zipf": np.minimum(rng.zipf(1.3, n), 50_000), "constant": np.full(n, 7),
           "cycle": np.arange(n) % 90, "large": rng.integers(0, 1 << 20, n), "one": np.array([5]), "none": np.zeros(0)}[kind]
    blocks = encode_blocks(ids.astype(np.uint32))
    assert decode_blocks(blocks).tolist() == ids.astype(int).tolist()
    if kind in ("constant", "cycle"):
        assert sum(map(len, blocks)) < n // 2


@pytest.mark.parametrize("kind", ["random", "zipf", "constant", "cycle", "large", "one"])
def test_segments_come_back(kind):
    rng = np.random.default_rng(5)
    n = 2 * BLOCK + 9
    ids = {"random": rng.integers(0, 50_257, n), "zipf": np.minimum(rng.zipf(1.3, n), 50_000), "constant": np.full(n, 7),
           "cycle": np.arange(n) % 90, "large": rng.integers(0, 1 << 20, n), "one": np.array([5])}[kind].astype(np.uint32)
    names, lengths, got = documents_of(segment([None, 4], np.array([0, len(ids)]), ids))
    assert (names, lengths.tolist(), got.tolist()) == ([None, 4], [0, len(ids)], ids.tolist())
    start = Start.of(ids)
    blocks = encode_blocks(ids, start)
    assert decode_blocks(blocks[-1:], Start.unpack(start.pack())).tolist() == ids[(len(ids) - 1) // BLOCK * BLOCK:].tolist()
    with pytest.raises(ValueError):
        encode_blocks(np.array([1_000_003], np.uint32), start)


def test_damaged_segments():
    payload = segment([1], np.array([5000]), (np.arange(5000) * 7 % 911).astype(np.uint32))
    for at in (9, 60, len(payload) // 2, len(payload) - 30):
        bad = bytearray(payload)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            documents_of(bytes(bad))


def test_fewer_bytes_than_counts_alone(sf):
    """On documents: below a code by counts over all ids, for which nothing is charged, and below zlib."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.concatenate([np.array(e.ids + [0], np.uint32) for e in tokenizer.encode_batch(
        [t or "" for t in texts], add_special_tokens=False)])
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    size = len(segment([0], np.array([len(ids)]), ids))
    assert size < -(share * np.log2(share)).sum() / 8 * len(ids)
    assert size < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_each_block_stands_alone():
    ids = np.random.default_rng(1).integers(0, 300, 4 * BLOCK).astype(np.uint32)
    blocks = encode_blocks(ids)
    assert decode_blocks(blocks[2:3]).tolist() == ids[2 * BLOCK:3 * BLOCK].tolist()


def test_damage_is_found():
    blocks = encode_blocks(np.arange(BLOCK, dtype=np.uint32) % 500)
    bad = bytearray(blocks[0])
    bad[40] ^= 1
    with pytest.raises(ValueError):
        decode_blocks([bytes(bad)])
    with pytest.raises(ValueError):
        encode_blocks(np.array([1 << 20], np.uint32))


def test_files_of_documents(spark, tmp_path):
    rng = random.Random(2)
    texts = {d: " ".join(rng.choice(["the", "énd", "on", "rat"]) for _ in range(rng.randint(0, 300))) for d in range(0, 400, 3)}
    rows = [(d, t, "x") for d, t in texts.items()] + [(7, None, None), (8, "", None), (10, "b " * 9000, None), (11, "same", None),
                                                      (11, "same", None), (None, "nobody", None)]
    rng.shuffle(rows)
    path = public_tokenizers.path("byte_bpe_50k.json")
    uri = str(tmp_path / "ids")
    rangecoder.write_ids(spark.createDataFrame(rows, SCHEMA), uri, path, segment_ids=5000)
    got = sorted(rangecoder.read_ids(spark, uri).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    start = 0
    for row, (d, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (d, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark, tmp_path):
    uri = str(tmp_path / "none")
    rangecoder.write_ids(spark.createDataFrame([], SCHEMA), uri, public_tokenizers.path("byte_bpe_50k.json"))
    assert rangecoder.read_ids(spark, uri).count() == 0
