"""Tokenizer ids of whole texts, each distinct piece encoded once.

Both vocabularies split before a space or line feed that follows a character
that is no white space, and between a Latin letter and a following mark of
``.,;:!?``, whatever stands around them. So a text cut there gives the same ids
piece by piece. Pieces of a chunk of texts are found and looked up as numpy
arrays; only new ones go to the tokenizer. A text with any other white space
character is encoded whole.

The table of known pieces is an open-addressing hash table of bounded size that
starts anew when it is full. Pieces are told apart by a 64-bit hash that
includes their length.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

from rosterlake.llm.common import powers, row_chunks

SLOT_BITS = 21
KNOWN_LIMIT = 1_200_000
#: Bytes of text to encode at a time: working arrays take up to 100 times that.
ENCODE_BYTES = 1 << 18
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
#: White space other than blank and line feed, in UTF-8.
OTHER_SPACE = re.compile(rb"[\t\v\f\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class PieceEncoder:
    """``encode(data, at)`` gives the ids of all rows and each row's number.

    ``lower`` says that the vocabulary folds case and drops white space.
    """

    def __init__(self, path: str, lower: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.entry = np.zeros(1 << SLOT_BITS, np.int32)
        self.begin, self.size, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.store, self.stored = np.zeros(1 << 18, np.uint32), 0

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where it is not known."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            key = self.keys[slot[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.entry[slot[todo[hit]]]
            todo = todo[~hit & (key != 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        """New distinct hashes and their pieces."""
        found = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.frombuffer(b"".join(found), np.uint32)
        n, m = self.known + len(h), self.stored + len(flat)
        while n > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while m > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.begin[self.known : n] = self.stored + np.cumsum(size) - size
        self.size[self.known : n] = size
        self.store[self.stored : m] = flat
        number = np.arange(self.known, n, dtype=np.int32)
        self.known, self.stored = n, m
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.entry[slot[won]] = number[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self._rows(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in row_chunks(at, ENCODE_BYTES)]
        return np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(size for _, size in found)])

    def _rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if OTHER_SPACE.search(data):
            parts = [self._whole(data[a:b]) if OTHER_SPACE.search(data[a:b]) else self._pieces(data[a:b], np.array([0, b - a]))[0]
                     for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)
        return self._pieces(data, at)

    def _whole(self, data: np.ndarray) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([data.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        if self.lower:
            data = _LOWER[data]
        blank = (data == 32) | (data == 10)
        letter = _LETTER[data]
        # The second byte of a Latin-1 letter: C3 80 to C3 BF but for two signs.
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (blank[1:] & ~blank[:-1]) | (_MARK[data[1:]] & letter[:-1])
        cut[at] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        if self.lower:
            # White space gives no ids: a piece begins after it.
            skip = np.concatenate([[0], np.cumsum(blank)])
            start = start + (skip[end] - skip[start])
            start, end = start[start < end], end[start < end]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers(BASE, n), out=sums[1:])
        h = (sums[end] - sums[start]) * powers(_INVERSE, n)[start] + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(29))) | np.uint64(1)
        ids, size = self._ids(data, h, start, end)
        before = np.cumsum(size) - size
        row = np.searchsorted(start, at)
        total = np.concatenate([before, [len(ids)]])
        return ids, np.diff(total[row])

    def _ids(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has."""
        entry = self._probe(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            if self.known + len(distinct) > KNOWN_LIMIT:
                if len(h) > KNOWN_LIMIT:
                    # So many pieces may be more than the table holds; part by part they aren't.
                    parts = [self._ids(data, *(x[p : p + KNOWN_LIMIT] for x in (h, start, end))) for p in range(0, len(h), KNOWN_LIMIT)]
                    return np.concatenate([ids for ids, _ in parts]), np.concatenate([size for _, size in parts])
                self._clear()
                new = np.arange(len(h))
                distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
            raw, base, at = data[start[0] : end[-1]].tobytes(), self.known, start[0]
            self._learn(distinct, [raw[a:b].decode() for a, b in zip((start[new[first]] - at).tolist(), (end[new[first]] - at).tolist(), strict=True)])
            entry[new] = base + back
        size = self.size[entry].astype(np.int64)
        before = np.cumsum(size) - size
        return self.store[np.repeat(self.begin[entry] - before, size) + np.arange(int(size.sum()))], size


@functools.lru_cache(maxsize=2)
def encoder(path: str, lower: bool = False) -> PieceEncoder:
    """One a Python worker: what earlier tasks have learned is used again."""
    return PieceEncoder(path, lower)
