"""Words, word hashes and window hashes of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15 | 1)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all their bits depend on each other (xor-shift, multiply)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int, which: str) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = int(_STEP) if which == "up" else pow(int(_STEP), -1, 1 << 64)
        grown = np.full((n >> 20) + 1 << 20, base, U)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        _powers[which] = have = grown
    return have[:n]


class Texts:
    """Some texts as one byte buffer; ``offsets[i]:offsets[i + 1]`` is text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of word bytes, and each text's first word.

        ``is_word`` says for each byte value whether it belongs to a word; runs end
        with their text.
        """
        mask = is_word[self.data]
        first = np.empty(len(mask), bool)
        first[:1] = True
        np.logical_not(mask[:-1], out=first[1:])
        cuts = self.offsets[:-1][self.offsets[:-1] < len(mask)]
        first[cuts] = True
        first &= mask
        last = np.empty(len(mask), bool)
        last[-1:] = True
        np.logical_not(mask[1:], out=last[:-1])
        ends = self.offsets[1:]
        last[ends[ends > 0] - 1] = True
        last &= mask
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """64-bit hash of each byte range; equal ranges have equal hashes."""
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        total = np.zeros(n + 1, U)
        own = total[1:]
        np.add(data, U(1), out=own)
        own *= _power(n, "up")
        np.cumsum(own, out=own)
        return mix((total[ends] - total[starts]) * _power(n + 1, "down")[starts])


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0]:offsets[-1]], offsets - offsets[0])


def portions(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The rows in portions of about ``size`` bytes of text, each text whole.

    A step holds some 100 bytes for each byte of its portion, in every worker of an executor.
    """
    for batch in batches:
        texts = texts_of(batch.column(batch.schema.get_field_index("text")))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(texts.offsets, texts.offsets[a] + size, "right")) - 1)
            lo, hi = texts.offsets[a], texts.offsets[b]
            yield batch.slice(a, b - a), Texts(texts.data[lo:hi], texts.offsets[a:b + 1] - lo)
            a = b


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, U)
    total = np.zeros(len(words) - n + 1, U)
    for j in range(n):
        total *= U(0xD6E8FEB86659FD93)
        total += words[j:len(words) - n + 1 + j]
    return mix(total + U(n))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
