"""Hashed character n-grams of whole texts as numpy arrays.

Texts are taken as UTF-8 bytes with A-Z in lower case and all ASCII white space
as a blank, so that n-grams know where words begin; an n-gram lies within
one text and is put into one of ``2**bits`` buckets.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (the last n-1 bytes
    start none)."""
    if len(data) < n:
        return np.zeros(0, np.int32)
    low = _LOWER[data].astype(np.uint64)
    code = low[: len(low) - n + 1].copy()
    for k in range(1, n):
        code = code << np.uint64(8) | low[k : len(low) - n + 1 + k]
    return ((code + np.uint64(n)) * _MIX >> np.uint64(64 - bits)).astype(np.int32)


def grams_per_row(data: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], bits: int):
    """For each row, the buckets of its n-grams of all sizes (with repeats)."""
    every = [(n, buckets(data, n, bits)) for n in sizes]
    for r in range(len(at) - 1):
        yield np.concatenate([b[at[r] : max(at[r], at[r + 1] - n + 1)] for n, b in every])
