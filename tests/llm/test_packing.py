"""Packing: each id in exactly one piece, full sequences, a true Hilbert order."""

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from doseloom.llm import packing, text

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, offset string"


def test_neighbours_on_the_curve_are_neighbours_on_the_grid():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        number = packing.hilbert(cells, bits)
        assert sorted(number.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(number)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pieces(spark):
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice(["the", "énd", "on", "Rat!"]) for _ in range(rng.randint(0, 200))), "x") for d in range(150)]
    rows += [(500, None, None), (501, "", None), (502, "long " * 5000, None), (None, "nobody", None)]
    rows += [(600 + k, "copies of one text", None) for k in range(60)]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), path, length=64).collect()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t, _ in rows}
    found = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == len(found.setdefault(r.doc_id, []))
        found[r.doc_id] += r.ids
        assert r.length == len(r.ids) and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert found == want
    line = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for sequence, offset, length in line:
        assert sequence * 64 + offset == at and offset + length <= 64
        at += length


def test_repeated_rows_and_empty_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "same text", None)] * 3
    got = packing.pieces(spark.createDataFrame(rows, SCHEMA), path).collect()
    assert len(got) == 3 and len({r.offset for r in got}) == 3
    assert packing.pieces(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_a_step_holds_little_beside_a_large_batch():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 600)) for _ in range(2000)]
    batch = pa.record_batch({"doc_id": pa.array(range(2000)), "text": pa.array(texts)})
    text._powers.update(up=np.ones(1, text.U), down=np.ones(1, text.U))
    tracemalloc.start()
    cells = np.concatenate([packing.grid(t) for _, t in text.portions([batch])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(cells) == 2000 and np.array_equal(cells, packing.grid(text.texts_of(batch.column(1))))
    assert peak < 90e6, peak  # 6.5 MB of text
