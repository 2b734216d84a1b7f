"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits becomes the bit counts of ``SEGMENTS`` segments. The
Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints, so pairs farther apart than the limit need no exact check.

Grid range-join: the segments form ``GROUPS`` groups. Counts that differ by at
most ``max_bits`` in all agree in at least ``GROUPS - max_bits`` groups. So a
grid cell is the counts of that many groups, and each fingerprint goes to the
cell of every choice of groups. In a cell the whole Manhattan distance is
tested, then the fingerprints themselves.

Equal fingerprints are one node. A cell of many fingerprints is dealt into
tiles of two chunks, so that each pair still meets in one tile; a tile returns
the links of a spanning forest, at most one for each of its fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import Scratch, append_struct, row_chunks, text_bytes
from rosterlake.llm.components import connected_components

SEGMENTS, GROUPS = 28, 7
CHUNK = 1024
SMALL_CELL = 12

_EDGES = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]
MASKS = [(1 << b) - (1 << a) for a, b in zip(_EDGES, _EDGES[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chunk_fingerprints(data: np.ndarray, at: np.ndarray, shingle: int) -> np.ndarray:
    import xxhash

    out = np.zeros(len(at) - 1, np.uint64)
    if not len(data):
        return out
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    rows = np.flatnonzero(np.diff(at))
    first, last = at[rows], at[rows + 1] - 1
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    opens[first] = word[first]
    closes[:-1] &= ~word[1:]
    closes[last] = word[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    # Words joined by one space: a word's bytes and the first space after it.
    keep = word.copy()
    keep[1:] |= word[:-1]
    place = np.cumsum(keep) - 1
    joined = np.where(word, low, 32)[keep].astype(np.uint8).tobytes()
    lo, hi = place[start], place[end] + 1
    row = np.searchsorted(at, start, "right") - 1
    words = np.bincount(row, minlength=len(out))
    begin = np.cumsum(words) - words
    n = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    head = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(head[some], n[some]) + np.repeat(begin[some], n[some])
    to = k + np.repeat(np.minimum(words[some], shingle), n[some]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(lo[k].tolist(), hi[to].tolist(), strict=True)), np.uint64, len(k))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, head[some], axis=0, dtype=np.int32)
    major = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little")
    out[some] = np.ascontiguousarray(major).view(np.uint64).ravel()
    return out


def add_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, out: str = "simhash") -> DataFrame:
    """``docs`` with a struct ``out``: fingerprint (long, the 64 bits).

    Words are runs without ASCII white space, A-Z lower-cased; shingles are
    joined by one space and hashed by XXH64 with seed 42. Fewer words than a
    shingle are one shingle; null, empty or blank texts have fingerprint zero.
    """

    def make():
        def of(batch: pa.RecordBatch):
            data, at = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            parts = [_chunk_fingerprints(data[at[i] : at[j]], at[i : j + 1] - at[i], shingle) for i, j in row_chunks(at)]
            return [pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64), pa.int64())]

        return of

    return append_struct(docs, out, T.StructType([T.StructField("fingerprint", T.LongType())]), make)


def _celled(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(cell, fp): a row for every choice of groups that may agree."""
    per = SEGMENTS // GROUPS
    groups = []
    for g in range(GROUPS):
        counts = [F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(m)))).cast("long") * (4**k) for k, m in enumerate(MASKS[per * g : per * (g + 1)])]
        groups.append(sum(counts[1:], counts[0]).alias(f"g{g}"))
    cells = []
    for c, chosen in enumerate(combinations(range(GROUPS), GROUPS - max_bits)):
        key = F.lit(c).cast("long")
        for g in chosen:
            key = key * (4**per) + F.col(f"g{g}")
        cells.append(key)
    return distinct.select("fp", *groups).select(F.explode(F.array(*cells)).alias("cell"), "fp")


def _near(fp: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs link: the Manhattan bound first, then the bits."""
    ok = np.abs(counts[a] - counts[b]).sum(axis=1) <= max_bits
    ok[ok] = np.bitwise_count(fp[a[ok]] ^ fp[b[ok]]) <= max_bits
    return ok


def _forest(fp: np.ndarray, counts: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    left = np.arange(len(fp))
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            p = stack.pop()
            ok = _near(fp, counts, left, np.full(len(left), p), max_bits)
            if ok.any():
                near, left = left[ok], left[~ok]
                yield np.full(len(near), p), near
                stack.extend(near.tolist())


def _links(fp: np.ndarray, run: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``run`` (sorted)."""
    size = np.bincount(run)
    alone = size[run] > 1
    fp, run = fp[alone], run[alone]
    found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    if not len(fp):
        return found_a[0], found_b[0]
    counts = np.bitwise_count(fp[:, None] & np.array(MASKS, np.uint64)).astype(np.int8)
    small = size[run] <= SMALL_CELL
    for s in range(1, min(SMALL_CELL, len(fp))):
        a = np.flatnonzero((run[:-s] == run[s:]) & small[:-s])
        if not len(a):
            break
        a = a[_near(fp, counts, a, a + s, max_bits)]
        found_a.append(fp[a])
        found_b.append(fp[a + s])
    for r in np.unique(run[~small]):
        i, j = np.searchsorted(run, [r, r + 1])
        for a, b in _forest(fp[i:j], counts[i:j], max_bits):
            found_a.append(fp[i:j][a])
            found_b.append(fp[i:j][b])
    return np.concatenate(found_a), np.concatenate(found_b)


def link_fingerprints(distinct: DataFrame, scratch: Scratch, max_bits: int = 4) -> DataFrame:
    """Links (a, b) of a table of distinct fingerprints (column fp) that
    connect all that are connected by pairs of at most ``max_bits`` bits."""
    if not 0 <= max_bits < GROUPS:
        raise ValueError(f"max_bits is 0 to {GROUPS - 1}")
    keyed = _celled(distinct, max_bits)
    hot = scratch.table(keyed.groupBy("cell").count().where(F.col("count") > 2 * CHUNK)
                        .select("cell", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "hot-cells")
    n = F.coalesce("chunks", F.lit(1))
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    dealt = (keyed.join(hot, "cell", "left").withColumn("chunk", chunk).withColumn("other", other)
             .select("cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")
             .repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def close(cols: list[np.ndarray]) -> pa.RecordBatch:
            cell, i, j, fp = cols
            new = np.concatenate([[0], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]).cumsum()
            a, b = _links(fp.view(np.uint64), new, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cell, i, j, _ = cols
            if not len(cell):
                continue
            cut = len(cell) - int(np.argmax(((cell != cell[-1]) | (i != i[-1]) | (j != j[-1]))[::-1]))
            if cut == len(cell) and cell[0] == cell[-1] and i[0] == i[-1] and j[0] == j[-1]:
                held = cols
                continue
            yield close([x[:cut] for x in cols])
            held = [x[cut:] for x in cols]
        if held is not None:
            yield close(held)

    return dealt.mapInArrow(link, "a long, b long")


def classes(fingerprints: DataFrame, scratch: Scratch, max_bits: int = 4) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint in a table
    (doc_id, fp): its class, and the smallest doc_id reachable over links. Null
    ids count only where a class has no other."""
    distinct = scratch.table(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = scratch.table(link_fingerprints(distinct.select("fp"), scratch, max_bits).distinct(), "links")
    nodes = scratch.table(connected_components(links, scratch).select(F.col("node").alias("fp"), "component"), "nodes")
    rooted = distinct.join(nodes, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = scratch.table(rooted, "rooted")
    least = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, root, component_id), a row per row of ``docs``; rows of a
    class share ``root``, the smallest fingerprint reachable.

    Null texts have fingerprint zero and link like any other; repeated rows
    and ids stay; other columns are not read; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = scratch.table(add_fingerprints(source, "text", shingle).select("doc_id", F.col("simhash.fingerprint").alias("fp")), "prints")
    classed = scratch.table(classes(prints, scratch, max_bits), "classes")
    return prints.join(classed, "fp").select("doc_id", "fp", "root", "component_id")
