"""Token ids of whole texts by a public tokenizer, with words encoded once per cache life.

A text is cut only where the tokenizer itself can't join anything across the cut, so the
ids of the parts put together are the ids of the text:

* ``spaces="dropped"`` (white space separates words and gives no ids): at blanks and line feeds;
* ``spaces="kept"`` (byte level, a blank goes with the word after it): where white space
  begins, and after a line feed that stands alone.

Special tokens that a text spells out are matched, as the tokenizer's file says; none of them holds white space, so no cut
goes through one. Next to bytes that may belong to white space outside ASCII nothing is cut. The tokenizer encodes
each distinct part; a table of bounded size remembers parts, known again by a 64-bit hash
and by their first bytes.
"""

from __future__ import annotations

import os

import numpy as np

from doseloom.llm.text import U, Texts, mix

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_ASCII_WHITE = _WHITE.copy()
_ASCII_WHITE[0x80:] = False
_WIDE = np.zeros(256, bool)  # lead bytes of white space beyond ASCII
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MOST_IDS = 14_000_000


class Encoder:
    """A tokenizer file and its memory of parts."""

    def __init__(self, path: str, spaces: str, slots: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        if spaces not in ("dropped", "kept"):
            raise ValueError("spaces is 'dropped' or 'kept'")
        self.tokenizer = Tokenizer.from_file(path)
        self.spaces = spaces
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.mark = " \x01 " if spaces == "dropped" else "\n"
        self.mark_ids = self._ids(self.mark if spaces == "kept" else "\x01")
        self.slots = slots
        self.shift = U(64 - slots.bit_length() + 1)
        self.forget()

    def forget(self) -> None:
        self.key, self.head = np.zeros(self.slots, U), np.zeros(self.slots, U)
        self.start, self.count = np.zeros(self.slots, np.int32), np.full(self.slots, -1, np.int16)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _cuts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts."""
        data, n = texts.data, len(texts.data)
        white, blank = _ASCII_WHITE[data], data == 0x20
        wide = _WIDE[data]
        near = np.zeros(n + 3, bool)  # this byte may be part of white space beyond ASCII
        for k in range(3):
            near[k:n + k] |= wide
        near = near[:n]
        ends = np.zeros(n + 1, bool)
        ends[texts.offsets] = True
        if self.spaces == "dropped":
            inside = ~(blank | (data == 0x0A))
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1] | ends[1:-1]
            last[:-1] &= ~inside[1:] | ends[1:-1]
            return np.flatnonzero(first), np.flatnonzero(last) + 1
        cut = ends.copy()
        before = ~white[:-1] & ~near[:-1]
        cut[1:-1] |= before & (blank[1:] | (data[1:] == 0x0A))
        cut[2:-1] |= before[:-1] & ~ends[1:-2] & (data[1:-1] == 0x0A) & ~white[2:] & ~wide[2:]
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts one after the other, and how many each has."""
        strings = [p.decode() for p in parts]
        plain, odd = [], []
        for k, p in enumerate(parts):
            rest = p[1:] if self.spaces == "kept" and p[:1] == b" " else p
            safe = rest and not any(c in rest for c in b"\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\x01\xc2\xe1\xe2\xe3")
            (plain if safe else odd).append(k)
        ids: list = [None] * len(parts)
        mark = self.mark_ids[0]
        for a in range(0, len(plain), 25_600):
            groups = [plain[b:b + 256] for b in range(a, min(a + 25_600, len(plain)), 256)]
            joined = self.tokenizer.encode_batch_fast([self.mark.join(strings[k] for k in g) for g in groups],
                                                      add_special_tokens=False)
            for g, e in zip(groups, joined):
                found = np.array(e.ids, np.uint32)
                at = np.flatnonzero(found == mark)
                if len(self.mark_ids) == 1 and len(at) == len(g) - 1:
                    for k, x, y in zip(g, [0, *(at + 1).tolist()], [*at.tolist(), len(found)]):
                        ids[k] = found[x:y]
                else:
                    odd += g
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([strings[k] for k in odd], add_special_tokens=False)):
            ids[k] = np.array(e.ids, np.uint32)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int32)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first place among them."""
        n = len(texts.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        begin, end = self._cuts(texts)
        size = end - begin
        key = mix(texts.hashes(begin, end, lower=False) + size.astype(U))
        padded = np.concatenate([texts.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(n + 1, U, padded, strides=(1,))[begin]
        short = np.minimum(size, 8)
        eight = np.where(short == 8, eight, eight & ((U(1) << (short % 8 * 8).astype(U)) - U(1)))
        slot = (key >> self.shift).astype(np.int64)
        start, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != key) | (self.head[slot] != eight) | (count < 0))
        if len(miss):
            order = miss[np.argsort(key[miss], kind="stable")]
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (eight[order][1:] != eight[order][:-1])
            which = np.cumsum(new) - 1
            fresh = order[new]
            ids, counts = self._encode([texts.data[a:b].tobytes() for a, b in zip(begin[fresh].tolist(), end[fresh].tolist())])
            if self.used + len(ids) > _MOST_IDS and self.used:
                # Old parts go; those that this call found in the table are encoded again.
                self.forget()
                return self.encode(texts)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(len(ids), self.used, 1 << 16), self.kind)])
            self.pool[self.used:self.used + len(ids)] = ids
            starts = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            keep = counts < 1 << 15  # a longer part is not remembered
            at = slot[fresh[keep]]
            self.key[at], self.head[at] = key[fresh[keep]], eight[fresh[keep]]
            self.start[at], self.count[at] = starts[keep], counts[keep]
            start[order], count[order] = starts[which], counts[which]
        total = np.append(0, np.cumsum(count, dtype=np.int64))
        place = np.arange(total[-1]) + np.repeat(start - total[:-1], count)
        return self.pool[place].astype(np.uint32), total[np.searchsorted(begin, texts.offsets)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, spaces: str) -> Encoder:
    """One encoder per worker process and file."""
    if (path, spaces) not in _encoders:
        _encoders.clear()
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]
