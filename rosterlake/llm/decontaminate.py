"""Benchmark decontamination with an FM-index per training shard.

A shard is the documents of an Arrow chunk. Its text is the sequence of word
numbers in the vocabulary of the test phrases. A word that no phrase has can't
lie in an occurrence, so it only breaks the sequence; runs between breaks that
are shorter than the shortest phrase can't hold one either. What is left,
every run closed by a break, gets a suffix array, its Burrows-Wheeler transform
in a wavelet matrix and suffix positions sampled every ``SAMPLE`` words.

All phrases are searched backward at once through the ranks; occurrences are
located by walking to a sampled position, and the covered words are merged
into removal spans of the document.

The phrases come in blocks of at most ``BLOCK_CHARS`` characters of benchmark
text, one broadcast each; every block passes over all documents in the same
stage. Words are compared by a 64-bit hash and their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import append_struct, codepoints_before, list_array, powers, row_chunks, text_bytes

WINDOW = 10
SAMPLE = 8
BLOCK_CHARS = 8 << 20
SHARD_BYTES = 8 << 20
BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_INVERSE = pow(BASE, -1, 1 << 64)

KIND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word of texts in one byte array."""
    if not len(data):
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    word = _WORD[data]
    rows = np.flatnonzero(np.diff(at))
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    opens[at[rows]] = word[at[rows]]
    closes[:-1] &= ~word[1:]
    closes[at[rows + 1] - 1] = word[at[rows + 1] - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[_LOWER[data]] * powers(BASE, len(data)), out=sums[1:])
    hashed = (sums[end] - sums[start]) * powers(_INVERSE, len(data))[start]
    hashed ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return start, end, np.searchsorted(at, start, "right") - 1, hashed


class Phrases:
    """Distinct windows of benchmark items, numbered by a word vocabulary."""

    def __init__(self, items: list, texts: list[str], window: int = WINDOW) -> None:
        data, at = text_bytes(pa.array(texts, pa.string()))
        _, _, row, hashed = words_of(data, at)
        self.vocabulary = np.unique(hashed)
        ids = np.searchsorted(self.vocabulary, hashed) + 1
        begin = np.searchsorted(row, np.arange(len(texts) + 1))
        owners: dict[tuple, set] = {}
        for r, item in enumerate(items):
            own = ids[begin[r] : begin[r + 1]].tolist()
            for k in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[k : k + window]), set()).add(item)
        by_length: dict[int, list] = {}
        for phrase in owners:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.groups = [(n, np.array(v, np.int64)) for n, v in sorted(by_length.items())]
        flat = [sorted(x for x in owners[p] if x is not None) for _, v in sorted(by_length.items()) for p in v]
        self.item_at = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
        self.item = np.array([x for own in flat for x in own], np.int64)
        self.shortest = min(by_length, default=0)


class WaveletMatrix:
    """rank(c, i): how many of the first i symbols are c; access(i)."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.ranks, self.zeros, self.levels = [], [], []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.levels.append(bit)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, i = np.zeros_like(i), i.copy()
        for level in range(self.bits):
            one = (c >> (self.bits - 1 - level) & 1).astype(bool)
            ones = self.ranks[level]
            a, b = ones[low], ones[i]
            low = np.where(one, self.zeros[level] + a, low - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level in range(self.bits):
            one, a = self.levels[level][i], self.ranks[level][i]
            out = out << 1 | one
            i = np.where(one, self.zeros[level] + a, i - a)
        return out


class FMIndex:
    """Index of a sequence over 1..top in which 0 closes each run. A break
    sorts before all words and breaks sort by place, so no suffix goes on
    past its run."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        n, ends = len(text), text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum())).astype(np.int64)
        step, order = 1, np.argsort(rank, kind="stable")
        while True:
            ordered = rank[order]
            if n < 2 or (ordered[1:] != ordered[:-1]).all():
                break
            dense = np.zeros(n, np.int64)
            dense[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            after = np.zeros(n, np.int64)
            after[: n - step] = dense[step:] + 1
            rank = dense * (n + 2) + after
            order, step = np.argsort(rank, kind="stable"), 2 * step
        self.n = n
        last = text[order - 1]
        self.tree = WaveletMatrix(last, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled, self.place = sampled, order[sampled]
        self.nth = np.cumsum(sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each phrase (a matrix of equal-length phrases)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        gone = np.ones(len(phrases), bool)
        gone[alive] = False
        low[gone] = high[gone] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.sampled[rows[todo]]
            out[todo[done]] = self.place[self.nth[rows[todo[done]]]] + steps
            todo = todo[~done]
            c = self.tree.access(rows[todo])
            rows[todo] = self.before[c] + self.tree.rank(c, rows[todo])
            steps += 1
        return out


def _search_shard(ids: np.ndarray, row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words hit, and (row, item) pairs, of a shard's word numbers."""
    hit = np.zeros(len(ids), bool)
    none = np.zeros(0, np.int64)
    if not phrases.shortest:
        return hit, none, none
    known = ids > 0
    new = known.copy()
    new[1:] &= ~known[:-1] | (row[1:] != row[:-1])
    run = np.cumsum(new) - 1
    where = np.flatnonzero(known)
    size = np.bincount(run[where]) if len(where) else none
    where = where[size[run[where]] >= phrases.shortest] if len(where) else where
    if not len(where):
        return hit, none, none
    close = np.flatnonzero(np.concatenate([run[where][1:] != run[where][:-1], [True]]))
    text = np.insert(ids[where], close + 1, 0)
    place = np.insert(where, close + 1, -1)
    index = FMIndex(text, len(phrases.vocabulary))
    change = np.zeros(len(text) + 1, np.int64)
    first, pairs_row, pairs_phrase = 0, [none], [none]
    for n, group in phrases.groups:
        low, high = index.search(group)
        times = high - low
        if times.any():
            rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            at = index.locate(rows)
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            pairs_row.append(row[place[at]])
            pairs_phrase.append(first + np.repeat(np.arange(len(group)), times))
        first += len(group)
    covered = np.cumsum(change[:-1]) > 0
    hit[place[covered & (place >= 0)]] = True
    pairs = np.unique(np.stack([np.concatenate(pairs_row), np.concatenate(pairs_phrase)]), axis=1)
    many = np.diff(phrases.item_at)[pairs[1]]
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(phrases.item_at[pairs[1]], many)
    own = np.unique(np.stack([np.repeat(pairs[0], many), phrases.item[k]]), axis=1)
    return hit, own[0], own[1]


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, at: np.ndarray, hit: np.ndarray):
    """Runs of hit words as code point spans, and how many each row has."""
    first = hit.copy()
    first[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    points = codepoints_before(data)
    own = row[first]
    base = points[at[own]]
    return points[start[first]] - base, points[end[last]] - base, np.bincount(own, minlength=len(at) - 1)


def _merge(a: list[dict] | None, b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*(a or []), *b], key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """The test set in blocks of bounded text; one block is held at a time."""
    items, texts, size = [], [], 0
    for r in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if items and size + len(r[1]) > BLOCK_CHARS:
            yield items, texts
            items, texts, size = [], [], 0
        items.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    yield items, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               window: int = WINDOW, out: str = "leaks") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, spans (code points,
    merged over neighbouring hit words, end exclusive) and items (distinct
    ids of items with an occurring window).

    A null or empty text has no words and no hits. Items without words have
    no window; an item whose id is null marks words and is named nowhere.
    Repeated rows are judged each for itself; no rows give no rows.
    """
    for k, (items, texts) in enumerate(benchmark_blocks(benchmark, item_col, item_text)):
        docs = _one_block(docs, Phrases(items, texts, window), text_col, out if k == 0 else f"{out}_{k}")
        if k:
            docs = _united(docs, text_col, out, f"{out}_{k}")
    return docs


def _united(docs: DataFrame, text_col: str, out: str, more: str) -> DataFrame:
    """Results of two blocks in one. The words hit by either are counted from
    the united spans, again in words."""
    def make():
        def of(batch: pa.RecordBatch):
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (out, more))
            data, at = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            start, end, row, _ = words_of(data, at)
            points = codepoints_before(data)
            start, begin = points[start] - points[at[row]], np.searchsorted(row, np.arange(len(at)))
            spans = [_merge(x["spans"], y["spans"]) for x, y in zip(a, b, strict=True)]
            hits = [sum(int(np.searchsorted(start[begin[r] : begin[r + 1]], s["end"]) - np.searchsorted(start[begin[r] : begin[r + 1]], s["start"])) for s in own)
                    for r, own in enumerate(spans)]
            return [[x["n_words"] for x in a], hits, spans, [sorted({*x["items"], *y["items"]}) for x, y in zip(a, b, strict=True)]]

        return of

    return append_struct(docs, "__both", KIND, make).drop(out, more).withColumnRenamed("__both", out)


def _one_block(docs: DataFrame, phrases: Phrases, text_col: str, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def make():
        phrases = shared.value
        vocabulary = phrases.vocabulary

        def of(batch: pa.RecordBatch):
            data, at = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            n_words, n_hit, starts, ends, n_spans, items, n_items = ([] for _ in range(7))
            for i, j in row_chunks(at, SHARD_BYTES):
                own, rel = data[at[i] : at[j]], at[i : j + 1] - at[i]
                start, end, row, ids = [], [], [], []
                for p, q in row_chunks(rel):
                    s, e, r, h = words_of(own[rel[p] : rel[q]], rel[p : q + 1] - rel[p])
                    k = np.searchsorted(vocabulary, h)
                    known = vocabulary[np.minimum(k, len(vocabulary) - 1)] == h if len(vocabulary) else np.zeros(len(h), bool)
                    start.append(s + rel[p])
                    end.append(e + rel[p])
                    row.append(r + p)
                    ids.append(np.where(known, k + 1, 0))
                start, end, row, ids = (np.concatenate(x) for x in (start, end, row, ids))
                hit, doc, item = _search_shard(ids, row, phrases)
                a, b, many = _spans(own, start, end, row, rel, hit)
                n_words.append(np.bincount(row, minlength=j - i))
                n_hit.append(np.bincount(row[hit], minlength=j - i))
                starts.append(a)
                ends.append(b)
                n_spans.append(many)
                items.append(item)
                n_items.append(np.bincount(doc, minlength=j - i))
            flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (n_words, n_hit, starts, ends, n_spans, items, n_items)]
            span = pa.StructArray.from_arrays([pa.array(flat[2]), pa.array(flat[3])], ["start", "end"])
            return [pa.array(flat[0]), pa.array(flat[1]), list_array(span, flat[4]), list_array(pa.array(flat[5]), flat[6])]

        return of

    return append_struct(docs, out, KIND, make)
