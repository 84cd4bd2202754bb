"""Ids of cut texts against the tokenizer on whole texts."""

import random

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from doseloom.llm.text import Texts  # noqa: E402
from doseloom.llm.tokens import Encoder  # noqa: E402

FILES = [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")]


def joined(texts):
    raw = [t.encode() for t in texts]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def check(encoder, texts, name):
    from tokenizers import Tokenizer
    ids, first = encoder.encode(joined(texts))
    direct = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
    for k, e in enumerate(direct):
        assert ids[first[k]:first[k + 1]].tolist() == e.ids, repr(texts[k][:200])


@pytest.mark.parametrize("name,spaces", FILES)
def test_odd_texts(name, spaces):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\u0085", "\x0b", "\x1c", "\x01", "a", "The", "'s", "'ll",
            "12", "3.5", "é", "É", "ß", "中文", "!", "...", "%%%", "<|endoftext|>", "<|startoftext|>", "</w>", "́", "İ", "🙂", "x" * 30,
            "\x00", "​", " ", "Σ", "ΑΣ"]
    texts = ["", " ", "\n", "a", " a", "a ", "a\n", "  a"] + \
        ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    encoder = Encoder(__import__("public_tokenizers").path(name), spaces, slots=1 << 8)
    check(encoder, texts, name)
    check(encoder, texts[::-1], name)


@pytest.mark.parametrize("name,spaces", FILES)
def test_given_documents(name, spaces, sf):
    texts = [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]
    check(Encoder(__import__("public_tokenizers").path(name), spaces), texts, name)


@pytest.mark.parametrize("name,spaces", FILES)
def test_special_tokens_that_a_text_spells_out(name, spaces):
    texts = ["a<|endoftext|>b", "<|startoftext|> The end <|endoftext|>", "x  <|endoftext|>\n\n<|endoftext|>", "<|endoftext|><|endoftext|> 's"]
    encoder = Encoder(public_tokenizers.path(name), spaces)
    check(encoder, texts, name)
    special = encoder.tokenizer.token_to_id("<|endoftext|>")
    ids, first = encoder.encode(joined(texts))
    assert [(ids[first[k]:first[k + 1]] == special).sum() for k in range(4)] == [1, 1, 2, 2]
