"""Importance resampling towards a target corpus, line by line.

Features are runs of one or two consecutive words, hashed into ``BUCKETS``
buckets by CRC-32. A line feed parts words, so texts are cut into lines:

1. one pass over the texts keeps, for each row, its lines' keys, its number of
   words and the buckets of the word pairs that span lines (the last word of a
   line with words and the first of the next);
2. equal lines are counted, and each distinct line is cut into features once;
   its bucket counts times its occurrences, and the pairs across lines, add up
   to the corpus counts;
3. a bucket's gain tells how much commoner it is in the target; a distinct
   line's gains are added once and reach every row that has the line by a join.

Lines are counted by their text; joins tell them apart by two 64-bit hashes. A hot line is one row after the
partial count; in the join of occurrences with line sums both sides are
exchanged, so adaptive execution can split it. The driver holds ``BUCKETS``
counts and gains, nothing that grows with the texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import Scratch, row_chunks, text_bytes
from rosterlake.llm.spans import word_spans
from rosterlake.operators.ids import dense_positions

BUCKETS = 10_000
#: Longer words go through zlib one by one.
_LONG = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words after lower-casing: digits, letters and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def _crc_table() -> np.ndarray:
    """The register after one byte, for the reflected polynomial of CRC-32."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> np.uint32(1) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


_CRC = _crc_table()


def _feed(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what led to ``crc`` followed by ``data[start:end]``, for each."""
    lens, out = end - start, ~crc
    for i in np.flatnonzero(lens > _LONG):
        out[i] = ~np.uint32(zlib.crc32(data[start[i] : end[i]].tobytes(), int(crc[i])))
    left = np.flatnonzero(lens <= _LONG)
    for k in range(_LONG):
        left = left[lens[left] > k]
        if not len(left):
            break
        now = out[left]
        out[left] = _CRC[(now ^ data[start[left] + k]) & np.uint32(255)] ^ now >> np.uint32(8)
    return ~out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _feed(np.zeros(len(start), np.uint32), data, start, end)


def pair_crcs(first: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of first word, blank, second word, given the first word's."""
    now = ~first
    blank = ~(_CRC[(now ^ np.uint32(32)) & np.uint32(255)] ^ now >> np.uint32(8))
    return _feed(blank, data, start, end)


def _bucket(crc: np.ndarray) -> np.ndarray:
    return (crc % np.uint32(BUCKETS)).astype(np.uint16)


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    data, at = text_bytes(column)
    for i, j in row_chunks(at):
        low, upto = _LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i]
        yield low, upto, word_spans(low, upto, WORD)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of uint16 bytes, and row offsets."""
    if not len(column):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    every = np.frombuffer(data, np.uint16) if data is not None and at[-1] else np.zeros(0, np.uint16)
    return every[at[0] : at[-1]], at - at[0]


def _with_word(line) -> Column:
    return line.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _keys(line) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def _rows(docs: DataFrame, text_col: str, id_col: str | None, scratch: Scratch, name: str) -> DataFrame:
    """(row, id, lines, n_words, across): a table of a row a text. ``lines`` are
    the keys of its lines with words, ``across`` the buckets of the pairs across
    lines as uint16 bytes."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: list[np.ndarray] = [np.zeros(0, np.int64)]
            pairs: list[bytes] = []
            for data, at, (start, end, row) in _chunks(b.column(3)):
                count.append(np.bincount(row, minlength=len(at) - 1))
                line = np.concatenate([[0], np.cumsum(data == 10)])[start]
                k = np.flatnonzero((row[1:] == row[:-1]) & (line[1:] != line[:-1]))
                found = _bucket(pair_crcs(word_crcs(data, start[k], end[k]), data, start[k + 1], end[k + 1]))
                cut = np.searchsorted(row[k], np.arange(len(at)))
                pairs += [found[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.concatenate(count)), pa.array(pairs, pa.binary())],
                                             ["row", "id", "lines", "n_words", "across"])

    lines = F.filter(F.split(F.col(text_col), "\n", -1), _with_word)
    source = docs.select(F.monotonically_increasing_id().alias("row"), (F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id"),
                         F.transform(lines, lambda line: F.struct(*_keys(line))).alias("lines"), F.col(text_col).alias("text"))
    kind = T.StructType([*source.schema.fields[:3], T.StructField("n_words", T.LongType()), T.StructField("across", T.BinaryType())])
    return scratch.table(source.mapInArrow(told, kind), name)


def _features(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct lines by key, how often they occur, and the buckets of their
    features, repeats included."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[bytes] = []
            for data, at, (start, end, row) in _chunks(b.column(3)):
                single = word_crcs(data, start, end)
                pair = _bucket(pair_crcs(single[:-1], data, start[1:], end[1:]))
                single, first = _bucket(single), np.searchsorted(row, np.arange(len(at)))
                held += [np.concatenate([single[a:z], pair[a : max(a, z - 1)]]).tobytes() for a, z in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(held, pa.binary())], ["k1", "k2", "n", "buckets"])

    lines = docs.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("line")).where(_with_word(F.col("line")))
    once = lines.groupBy("line").agg(F.count("*").alias("n"))
    return once.select(*_keys(F.col("line")), "n", "line").mapInArrow(cut, "k1 long, k2 long, n long, buckets binary")


def _totals(lines: DataFrame, rows: DataFrame) -> np.ndarray:
    """Features by bucket over lines times occurrences, and pairs across."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            every, at = _flat(b.column(1))
            # Weights are doubles: whole and exact far beyond a batch's counts.
            total += np.bincount(every, np.repeat(b.column(0).to_numpy(), np.diff(at)), BUCKETS).astype(np.int64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k])], ["bucket", "n"])

    every = lines.select("n", "buckets").unionAll(rows.select(F.lit(1).cast("long").alias("n"), "across"))
    total = np.zeros(BUCKETS, np.int64)
    for r in every.mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the raw)."""
    s_all, t_all = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + BUCKETS) / (float(s + 1) * float(t_all + BUCKETS))))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _sums(df: DataFrame, column: str, gain: np.ndarray) -> DataFrame:
    """``df`` with its buckets replaced by the sum of their gains."""
    shared = df.sparkSession.sparkContext.broadcast(gain)
    keep = [c for c in df.columns if c != column]
    kind = T.StructType([*df.select(keep).schema.fields, T.StructField("gain", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, at = _flat(b.column(len(keep)))
            upto = np.concatenate([[0], np.cumsum(shared.value[every])])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.diff(upto[at]))], [*keep, "gain"])

    return df.select(*keep, column).mapInArrow(add, kind)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7",
             text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for every row of ``docs``:
    weight is the floored mean gain of its features towards ``target``'s texts,
    score adds Gumbel noise from the id, and rank numbers the drawn rows from 1
    by falling score, then rising id: ``percent`` of the rows with
    ``least_words`` or more.

    A null text has no words: weight 0, never drawn. A null id draws its noise
    like the empty text, and comes last among equal scores. Rows of one id are
    ranked each for itself, the one with fewer words first where scores tie.
    Other columns are not looked at; empty tables give empty results, an empty
    target gives gains from the smoothing alone.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    rows = _rows(docs, text_col, id_col, scratch, "rows")
    lines = scratch.table(_features(docs, text_col), "lines")
    wanted = _rows(target, text_col, None, scratch, "target-rows")
    gain = gains(_totals(lines, rows), _totals(_features(target, text_col), wanted))

    told = scratch.table(_sums(lines.select("k1", "k2", "buckets"), "buckets", gain), "line-gains")
    scratch.drop(lines, wanted)
    found = rows.select("row", F.explode("lines").alias("of")).select("row", "of.k1", "of.k2").join(told, ["k1", "k2"])
    own = _sums(rows.select("row", "id", "n_words", "across"), "across", gain)
    total = own.join(found.groupBy("row").agg(F.sum("gain").alias("within")), "row", "left").withColumn(
        "gain", F.col("gain") + F.coalesce("within", F.lit(0)))
    n_features = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    # Whole numbers throughout: the floor of a quotient of longs.
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = scratch.table(total.select("id", "n_words", "gain").withColumn("n_features", n_features).withColumn("weight", mean.cast("long"))
                           .withColumn("score", F.col("weight") + noise).drop("gain"), "scored")
    scratch.drop(rows, told)

    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    ranked = dense_positions(scored.where(able), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features")], name="rank")
    every = ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
