"""Words of a chunk of texts as byte spans, and exact word ids.

A chunk is one byte array with row offsets (``common.text_bytes``). A word is a
longest run of bytes that ``inside`` marks; no word crosses a row's border.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of words parted by ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def word_spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order."""
    mark = inside[data]
    before, after = np.zeros(len(mark), bool), np.zeros(len(mark), bool)
    before[1:], after[:-1] = mark[:-1], mark[1:]
    filled = at[:-1] < at[1:]
    before[at[:-1][filled]] = False
    after[at[1:][filled] - 1] = False
    start, end = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The id of each word among the chunk's distinct words, and those words
    as binary values; equal ids are equal bytes."""
    lens = end - start
    offsets = np.concatenate([[0], np.cumsum(lens)])
    place = np.repeat(start - offsets[:-1], lens) + np.arange(offsets[-1])
    packed = np.ascontiguousarray(data[place])
    words = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of a value a byte over each row."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[at[1:]] - upto[at[:-1]]
