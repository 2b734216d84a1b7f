"""Removal of every byte that a repeated ``length``-byte string covers.

Candidates. A rolling hash of ``GRAM``-byte grams is taken at every byte; the
least one in each window of ``length`` bytes is its anchor. Equal windows have
equal anchors at equal places, so a window can repeat only where its anchor's
hash occurs twice. Counts of hashes are pre-aggregated; copies of a whole text
count once and are removed whole.

Contexts. All windows with an anchor in column a (a bytes after their start)
lie in the context around the anchor. Contexts of an anchor form a group; equal
contexts collapse to one, which settles all their windows.

Column-wise construction. The distinct contexts of a group, aligned at their
anchor, are a collection of documents. From the last column to the first, each
round inserts one symbol per context: the contexts are ranked by that symbol
and the order so far, which gives the order of their suffixes, the transform's
symbols being the column before in that order; common prefixes of neighbours
follow from range minima over the prefixes so far. A suffix with ``length``
bytes in common with a neighbour is a repeated window.

A group of more than ``LIMIT`` contexts is dealt anew by narrower ranges of
columns, whose windows share more bytes, down to single windows, which are
settled by counting. So no group is held that grows with the corpus.

Strings are compared by 64-bit hashes in groups of equal 64-bit hashes, and
byte by byte in the construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import Scratch, powers, row_chunks, text_bytes

LENGTH = 200
GRAM = 64
LIMIT = 16_000
BATCH = 24_000
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of substrings of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return _mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    n, span = len(x) - width + 1, 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and hash of every anchor in texts of one byte array."""
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64)
    start = np.arange(len(data) - GRAM + 1)
    h = Hasher(data).of(start, start + GRAM)
    end = np.repeat(at[1:], np.diff(at))
    least = _least(h, width)
    own = np.arange(len(least))
    least[own + length > end[own]] = 0
    pad = np.zeros(width - 1, np.uint64)
    most = ~_least(~np.concatenate([pad, least, pad]), width)
    place = np.flatnonzero((h == most) & (most > 0))
    place = place[place + GRAM <= end[place]]
    return place, h[place]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"),
                       F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("tie"))


def _all_anchors(docs: DataFrame, length: int, columns: list[str]) -> DataFrame:
    """(hash, loc) or (hash, k1, pos) of the anchors of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            k1, k2 = (np.asarray(c).view(np.uint64) for c in b.columns[1:])
            for i, j in row_chunks(at):
                rel = at[i : j + 1] - at[i]
                place, h = anchors(data[at[i] : at[j]], rel, length)
                row = np.searchsorted(rel, place, "right") - 1
                pos = place - rel[row]
                loc = _mix(k1[i + row] ^ _mix(k2[i + row] + pos.astype(np.uint64)))
                every = {"hash": h.view(np.int64), "loc": loc.view(np.int64), "k1": k1[i + row].view(np.int64), "pos": pos}
                yield pa.RecordBatch.from_arrays([pa.array(every[c]) for c in columns], columns)

    return docs.where(F.octet_length("text") >= length).select("text", "k1", "k2").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _ranges(place: np.ndarray, first: np.ndarray, size: np.ndarray, width: int, length: int):
    """Valid columns of a range: ``place`` is the anchor in its text."""
    top = length - GRAM
    lo = np.maximum(first, place + length - size)
    hi = np.minimum(np.minimum(first + width - 1, top), place)
    return lo, hi


def _each_range(b: pa.RecordBatch, width: int, length: int):
    """Per chunk of a batch (doc, text, at list<(pos, first)>): the bytes, the
    anchors' offsets and the ranges of columns to look at."""
    data, at = text_bytes(b.column(1))
    doc = np.asarray(b.column(0))
    todo = b.column(2)
    for i, j in row_chunks(at):
        part = todo.slice(i, j - i)
        flat = part.flatten()
        row = np.repeat(np.arange(i, j), np.asarray(part.value_lengths()))
        pos, first = np.asarray(flat.field("pos")), np.asarray(flat.field("first"))
        size, base = at[row + 1] - at[row], at[row] - at[i]
        lo, hi = _ranges(pos, first, size, width, length)
        ok = lo <= hi
        yield data[at[i] : at[j]], doc[row][ok], pos[ok], first[ok], lo[ok], hi[ok], base[ok]


def _level_rows(texts: DataFrame, width: int, length: int) -> DataFrame:
    """(g, c, doc, pos, first, lo, hi): hashes of the bytes that all windows of
    a range share, and of its whole context."""
    top = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, doc, pos, first, lo, hi, base in _each_range(b, width, length):
                hasher, p = Hasher(data), base + pos
                last = np.minimum(first + width - 1, top)
                g = _mix(hasher.of(p - first, p - last + length) + first.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
                c = _mix(hasher.of(p - hi, p - lo + length) + (hi * 1000 + lo).astype(np.uint64))
                cols = [g.view(np.int64), c.view(np.int64), doc, pos, first, lo, hi]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["g", "c", "doc", "pos", "first", "lo", "hi"])

    return texts.mapInArrow(run, "g long, c long, doc long, pos long, first long, lo long, hi long")


def repeated_columns(text: np.ndarray, group: np.ndarray, width: int, length: int) -> np.ndarray:
    """Column-wise construction over aligned contexts.

    ``text`` is a matrix of symbols, 256 where a context has no byte; column
    ``width - 1`` onwards is shared alignment. Returns, for each context and
    each of the first ``width`` columns, whether the window that starts there
    repeats in another context of its group."""
    n, columns = text.shape
    order = np.argsort(group, kind="stable")
    prefix = np.zeros(n + 1, np.int32)
    out = np.zeros((n, width), bool)
    for j in range(columns - 1, -1, -1):
        symbol = text[order, j]
        key = group[order].astype(np.int64) * 257 + symbol
        step = np.argsort(key, kind="stable")
        key = key[step]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (symbol[step][1:] < 256)])
        cur = np.flatnonzero(same)
        now = np.zeros(n + 1, np.int32)
        if len(cur):
            # Range minimum of the old prefixes between the two old ranks.
            pairs = np.stack([step[cur - 1] + 1, step[cur] + 1], axis=1).ravel()
            now[cur] = 1 + np.minimum.reduceat(prefix, pairs)[::2]
        order, prefix = order[step], now
        if j < width:
            long = prefix >= length
            out[order, j] = long[:-1] | long[1:]
    return out


def _contexts(texts: DataFrame, width: int, length: int) -> DataFrame:
    """(g, doc, pos, first, left, context) of the ranges to construct."""
    top = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, doc, pos, first, lo, hi, base in _each_range(b, width, length):
                hasher, p, raw = Hasher(data), base + pos, data.tobytes()
                last = np.minimum(first + width - 1, top)
                g = _mix(hasher.of(p - first, p - last + length) + first.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
                own = [raw[s:e] for s, e in zip((p - hi).tolist(), (p - lo + length).tolist(), strict=True)]
                cols = [pa.array(x.astype(np.int64)) for x in (g.view(np.int64), doc, pos, first, last - hi)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.binary())], ["g", "doc", "pos", "first", "skip", "context"])

    return texts.mapInArrow(run, "g long, doc long, pos long, first long, skip long, context binary")


def _construct(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """(doc, pos, lo, hi): columns of windows that repeat, group by group."""
    top = length - GRAM

    def solve(cols: list) -> Iterator[pa.RecordBatch]:
        g, doc, pos, first, skip, context = cols
        _, group = np.unique(g, return_inverse=True)
        counts = np.bincount(group)
        some = np.flatnonzero(counts[group] > 1)
        if not len(some):
            return
        matrix = np.full((len(some), width - 1 + length), 256, np.int16)
        for r, i in enumerate(some):
            own = np.frombuffer(context[i], np.uint8)
            matrix[r, skip[i] : skip[i] + len(own)] = own
        found = repeated_columns(matrix, group[some], width, length)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        row_last = np.minimum(first[some][row] + width - 1, top)
        # Column index k holds windows with their anchor last - k bytes on.
        cols = [doc[some][row], pos[some][row], row_last - (end - 1), row_last - begin]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["doc", "pos", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                cols = [*(np.asarray(c) for c in part.columns[:5]), np.array(part.column(5).to_pylist(), object)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
                if len(held[0]) < BATCH:
                    continue
                cut = int(np.searchsorted(held[0], held[0][-1], "left"))
                if cut:
                    yield from solve([x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if held is not None:
            yield from solve(held)

    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(run, "doc long, pos long, lo long, hi long")


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept): what is left of each text, from
    (k1, k2, text, hits list<(pos, lo, hi)>)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(2))
            removed, spans, kept = [], [], []
            for r in range(b.num_rows):
                own, hits = data[at[r] : at[r + 1]], b.column(3)[r].values
                change = np.zeros(len(own) + 1, np.int32)
                pos = np.asarray(hits.field("pos"))
                np.add.at(change, pos - np.asarray(hits.field("hi")), 1)
                np.add.at(change, pos - np.asarray(hits.field("lo")) + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum()))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                             ["k1", "k2", "n_removed", "n_spans", "kept"])

    return texts.select("k1", "k2", "text", "hits").mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary")


def repeated_text(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, copies) of every distinct text, and (k1, k2, n_removed,
    n_spans, kept) of those with a repeated window, from ``_keyed`` rows."""
    if length < 2 * GRAM:
        raise ValueError(f"length is at least {2 * GRAM}")
    top = length - GRAM
    keys = scratch.table(docs.groupBy("k1", "k2").agg(F.min("tie").alias("tie"), F.count("*").alias("copies")), "keys")
    twice = scratch.table(_all_anchors(docs, length, ["hash", "loc"]).groupBy("hash").agg(F.min("loc").alias("a"), F.max("loc").alias("b"))
                          .where("a < b").select("hash"), "twice")
    found = _all_anchors(docs, length, ["hash", "k1", "pos"]).join(twice, "hash")
    places = scratch.table(found.groupBy("k1").agg(F.collect_set("pos").alias("pos")), "places")
    wanted = scratch.table(keys.join(places, "k1").select("k1", "k2", "tie", "pos"), "wanted")
    texts = scratch.table(docs.select("k1", "k2", "tie", "text").join(wanted, ["k1", "k2", "tie"])
                          .select(F.monotonically_increasing_id().alias("doc"), "k1", "k2", "text", "pos"), "texts")
    # A row that repeats with its id is one text: the first of its rows.
    one = scratch.table(texts.groupBy("k1", "k2").agg(F.min("doc").alias("doc")), "one")
    texts_one = texts.join(one.select("doc"), "doc", "left_semi")

    hits: list[DataFrame] = []
    now = texts_one.select("doc", "text", F.transform("pos", lambda p: F.struct(p.alias("pos"), F.lit(0).cast("long").alias("first"))).alias("at"))
    widths = [top + 1, 17, 1]
    for k, width in enumerate(widths):
        rows = scratch.table(_level_rows(now, width, length), f"rows-{width}")
        distinct = scratch.table(rows.groupBy("g", "c").agg(F.min(F.xxhash64("doc", "pos")).alias("least"), F.max(F.xxhash64("doc", "pos")).alias("most")), f"distinct-{width}")
        sizes = scratch.table(distinct.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), f"sizes-{width}")
        told = scratch.table(distinct.join(sizes, "g", "left").where("least < most or n is not null"), f"told-{width}")
        settled = scratch.table(rows.join(told, ["g", "c"]).withColumn("shared", F.expr("least < most"))
                                .withColumn("go_on", F.expr("n is not null and xxhash64(doc, pos) = least"))
                                .where("shared or go_on").select("doc", "pos", "first", "lo", "hi", "n", "shared", "go_on"), f"settled-{width}")
        scratch.drop(rows, distinct, sizes, told)
        hits.append(settled.where("shared").select("doc", "pos", "lo", "hi"))
        if width == 1:
            break

        def listed(chosen: DataFrame) -> DataFrame:
            lists = chosen.groupBy("doc").agg(F.collect_list(F.struct("pos", "first")).alias("at"))
            return texts.select("doc", "text").join(lists, "doc").select("doc", "text", "at")

        small = settled.where(f"go_on and n <= {LIMIT}").select("doc", "pos", "first")
        hits.append(scratch.table(_construct(_contexts(listed(small), width, length), width, length), f"constructed-{width}"))
        narrower = widths[k + 1]
        firsts = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + width - 1, F.lit(top)), F.lit(narrower).cast("long")))
        now = listed(settled.where(f"go_on and n > {LIMIT}").select("doc", "pos", firsts.alias("first")))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    spans = scratch.table(every.groupBy("doc").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("hits")), "hits")
    return keys, scratch.table(_cut(texts.join(spans, "doc"), length), "cut")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), a row per row.

    A text that occurs twice repeats all its windows. Null texts are empty;
    texts under ``length`` bytes stay; repeated rows and null ids are texts
    like any other; other columns are not read; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    source = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    keys, cut = repeated_text(source, scratch, length)
    info = scratch.table(keys.join(cut, ["k1", "k2"], "left").select("k1", "k2", "copies", "n_removed", "n_spans", "kept"), "info")
    n = F.octet_length("text").cast("long")
    whole = (F.col("copies") > 1) & (n >= length)
    return source.join(info, ["k1", "k2"]).select(
        "doc_id", n.alias("n_bytes"), F.when(whole, n).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit("").cast("binary")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept"))
