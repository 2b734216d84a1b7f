"""Quality rules: fixed counts of a text, then a calibrated classifier.

The classifier is a logistic regression over the presence of hashed words, word
pairs and character n-grams (``HASH_BITS`` buckets, case kept, white space as
one blank), each text's presence vector scaled to length 1, so that long texts
weigh like short ones. It is fitted on a sample of about ``SAMPLE_ROWS``
labelled rows, chosen by a hash of text and id. Rows of ``1/FOLDS`` of all texts
never enter the fit: on all of them, counted by score in bins, Platt's
two numbers turn a score into a probability. Texts are scored in Arrow batches;
a text is kept if no fixed rule fails and its probability of good quality is
``KEEP`` or more.

Null and empty texts have no word and fail the fixed rule of 20 words. Only the
text is looked at, so repeated rows get equal results, and every column stays
but one named like the result. Without labelled rows of both classes every
probability is the share of good rows (one half without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import Scratch, append_struct, powers, row_chunks, text_bytes
from rosterlake.llm.spans import NOT_SPACE, per_row, word_ids, word_spans
from rosterlake.llm.toxicity import _minimum

SIZES = (3, 4)
HASH_BITS = 18
SAMPLE_ROWS = 20_000
RIDGE = 1e-5
FOLDS = 5
KEEP = 0.5
#: Fixed rules: least words, and the share of repeated words in per cent.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: Calibration bins a unit of score, and the score beyond which all is one bin.
BINS, FAR = 64, 40
#: Entries of a block of the sample, and partitions that hold it.
BLOCK, PARTS = 1 << 20, 6

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_BLANK = np.where(NOT_SPACE, np.arange(256), 32).astype(np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_WINDOW_KEYS = powers(0xD6E8FEB86659FD93, WINDOW + 2)[1:] | np.uint64(1)

KIND = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                    + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


@dataclass
class QualityModel:
    """Weights of the buckets, and score -> probability (slope, shift)."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    keep: float = KEEP


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code * _MIX >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def _word_codes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    lens = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lens)
    terms = (data + np.uint64(1)) * powers(_BASE, int(lens.max(initial=0)))[place]
    return np.add.reduceat(terms, offsets[:-1] - offsets[0]) if len(words) else np.zeros(0, np.uint64)


def features(data: np.ndarray, at: np.ndarray, spans: tuple) -> Iterator[np.ndarray]:
    """The buckets that each text of a chunk has, once each."""
    _, _, row, ids, words = spans
    code = _word_codes(words)[ids]
    single, pair = _bucket(code ^ np.uint64(1)), _bucket(code[:-1] * _MIX + code[1:])
    first = np.searchsorted(row, np.arange(len(at)))
    low = _BLANK[data]
    grams = []
    for n in SIZES:
        total = low[: max(0, len(low) - n + 1)].copy()
        for k in range(1, n):
            total = total << np.uint64(8) | low[k : len(low) - n + 1 + k]
        grams.append((n, _bucket(total + np.uint64(n << 60))))
    last = np.zeros(1 << HASH_BITS, np.int64)
    for r in range(len(at) - 1):
        a, b = first[r], first[r + 1]
        every = np.concatenate([single[a:b], pair[a : max(a, b - 1)], *[g[at[r] : max(at[r], at[r + 1] - n + 1)] for n, g in grams]])
        place = np.arange(len(every))
        last[every] = place
        yield every[last[every] == place]


def repeated_words(ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each text, its words that lie in a window of ``WINDOW`` words which
    the text has twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(rows, np.int64)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    keys = [ids[at + k] for k in range(WINDOW)] + [row[at]]
    code = np.zeros(len(at), np.uint64)
    for k, key in enumerate(keys):
        code += key.astype(np.uint64) * _WINDOW_KEYS[k]
    order = np.argsort(code, kind="stable")
    near = code[order[1:]] == code[order[:-1]]
    equal = near.copy()
    for key in keys:
        equal &= key[order[1:]] == key[order[:-1]]
    if (near & ~equal).any():  # two windows of one hash: order them by their words
        order = np.lexsort(keys)
        equal = np.ones(len(order) - 1, bool)
        for key in keys:
            equal &= key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    step[at[again]] += 1
    step[at[again] + WINDOW] -= 1
    return np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=rows)


def counts(data: np.ndarray, at: np.ndarray, spans: tuple) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words by text."""
    start, end, row, ids, _ = spans
    rows = len(at) - 1
    points = per_row(NOT_SPACE[data] & ((data & 0xC0) != 0x80), at)
    doubled = np.zeros(rows, np.int64)
    for r in range(rows):
        lines = [line for line in data[at[r] : at[r + 1]].tobytes().split(b"\n") if line.strip()]
        doubled[r] = len(lines) - len(set(lines))
    return [np.bincount(row, minlength=rows), points, per_row(_SYMBOL[data], at), doubled, repeated_words(ids, row, rows)]


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    data, at = text_bytes(column)
    for i, j in row_chunks(at):
        part, upto = data[at[i] : at[j]], at[i : j + 1] - at[i]
        found = word_spans(part, upto)
        yield part, upto, (*found, *word_ids(part, found[0], found[1]))


def _blocks(sample: DataFrame) -> DataFrame:
    """The sample's features in blocks of about ``BLOCK`` entries: labels,
    numbers of buckets and buckets, each as int32 bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        good: list[int] = []
        entries = 0

        def block() -> pa.RecordBatch:
            parts = np.array(good, np.int32), np.array([len(f) for f in held], np.int32), np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["good", "sizes", "buckets"])

        for b in batches:
            label, i = b.column(1).to_pylist(), 0
            for data, at, spans in _chunks(b.column(0)):
                for found in features(data, at, spans):
                    held.append(found)
                    good.append(label[i])
                    i, entries = i + 1, entries + len(found)
                    if entries >= BLOCK:
                        yield block()
                        held, good, entries = [], [], 0
        if held:
            yield block()

    return sample.mapInArrow(pack, "good binary, sizes binary, buckets binary")


def _sums(blocks: DataFrame, weight: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows: the log loss's gradient by bucket, and the sums of loss,
    of errors, of rows and of good rows. Tasks add up, the driver gets a vector
    of single precision a partition."""
    size = len(weight)
    shared = blocks.sparkSession.sparkContext.broadcast((weight, bias))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        gradient, told = np.zeros(size), np.zeros(4)
        for b in batches:
            for good, sizes, buckets in zip(*b.columns, strict=True):
                y, n, k = (np.frombuffer(x.as_buffer(), np.int32) for x in (good, sizes, buckets))
                norm = 1 / np.sqrt(np.maximum(n, 1))
                z = np.diff(np.concatenate([[0], np.cumsum(weight[k])])[np.concatenate([[0], np.cumsum(n)])]) * norm + bias
                err = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
                gradient += np.bincount(k, np.repeat(err * norm, n), minlength=size)
                told += (np.logaddexp(0, z) - y * z).sum(), err.sum(), len(y), y.sum()
        yield pa.RecordBatch.from_arrays([pa.array([gradient.astype(np.float32).tobytes()], pa.binary()), pa.array([told.tobytes()], pa.binary())], ["gradient", "told"])

    found = blocks.coalesce(PARTS).mapInArrow(part, "gradient binary, told binary").collect()
    shared.destroy()
    return sum((np.frombuffer(r[0], np.float32) for r in found), np.zeros(size)), sum((np.frombuffer(r[1]) for r in found), np.zeros(4))


def _fit(blocks: DataFrame) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge, over the blocks' rows."""
    zero = np.zeros(1 << HASH_BITS)
    _, (_, _, n, good) = _sums(blocks, zero, 0.0)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        gradient, told = _sums(blocks, x[:-1], float(x[-1]))
        return told[0] / n + RIDGE / 2 * (x[:-1] @ x[:-1]), np.append(gradient / n + RIDGE * x[:-1], told[1] / n)

    x = np.append(zero, np.log((good + 0.5) / (n - good + 0.5)))
    x = _minimum(value, x) if n else x
    return x[:-1], float(x[-1])


def platt(z: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that best tells ``good`` from ``bad`` rows
    at each score ``z``, by Newton steps; with Platt's targets, which stay off 0
    and 1. Without rows of both classes the score stays as it is."""
    n1, n0 = good.sum(), bad.sum()
    if not (n1 and n0):
        return 1.0, 0.0
    n = good + bad
    target = (good * (n1 + 1) / (n1 + 2) + bad / (n0 + 2)) / np.maximum(n, 1)

    def loss(x: np.ndarray) -> float:
        t = x[0] * z + x[1]
        return float((n * (np.logaddexp(0, t) - target * t)).sum())

    x = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x[0] * z + x[1], -700, 700)))
        g = np.array([(n * (p - target) * z).sum(), (n * (p - target)).sum()])
        w = n * np.maximum(p * (1 - p), 1e-12)
        step = np.linalg.solve(np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-9 * np.eye(2), g)
        scale = 1.0
        while scale > 1e-6 and loss(x - scale * step) > loss(x):
            scale /= 2
        x = x - scale * step
        if np.abs(step).max() < 1e-9:
            break
    return float(x[0]), float(x[1])


def _raw(column: pa.Array, model: QualityModel) -> np.ndarray:
    z = [model.weight[f].sum() / np.sqrt(max(len(f), 1)) for data, at, spans in _chunks(column) for f in features(data, at, spans)]
    return np.array(z, float) + model.bias


def _calibrate(rows: DataFrame, model: QualityModel) -> QualityModel:
    """Platt's numbers over all rows of ``rows(text, good)``, counted by bin."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.round(np.clip(_raw(b.column(0), shared.value), -FAR, FAR) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), b.column(1)], ["bin", "good"])

    found = rows.mapInArrow(bins, "bin int, good int").groupBy("bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).toPandas()
    shared.destroy()
    slope, shift = platt(found["bin"].to_numpy() / BINS, found["good"].to_numpy(float), found["bad"].to_numpy(float))
    return QualityModel(model.weight, model.bias, slope, shift, model.keep)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id") -> QualityModel:
    """Learn from rows (text, 0/1 label). Rows without a label or text teach
    nothing. All copies of a text are in the fit or in the calibration. The
    sample goes by text and ``id_col``, or without that by text and row number."""
    scratch = Scratch(labelled.sparkSession, "quality")
    told = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
    n = {r["good"]: r["n"] for r in told.groupBy(F.col(label_col).cast("int").alias("good")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return QualityModel(np.zeros(1 << HASH_BITS), float(np.log(share / (1 - share))))
    share = min(1.0, SAMPLE_ROWS / sum(n.values()))
    pick = F.pmod(F.xxhash64(text_col, id_col if id_col in labelled.columns else F.monotonically_increasing_id()), F.lit(1 << 20)) < int(share * (1 << 20))
    held = F.crc32(F.col(text_col).cast("binary")) % FOLDS == 0
    # Both conditions read the text's side alone: of a join with labels, only
    # texts that are used are shuffled.
    rows = scratch.table(told.where(held | pick).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("good"), held.alias("held")), "rows")
    sample = rows.where(~F.col("held")).select("text", "good")
    blocks = scratch.table(_blocks(sample.repartition(PARTS)), "blocks")
    model = _calibrate(rows.where("held").select("text", "good"), QualityModel(*_fit(blocks)))
    scratch.drop(rows, blocks)
    return model


def assess(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: the fixed counts, base_failed, score (the
    probability of good quality) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def of(batch: pa.RecordBatch):
            told: list[list[np.ndarray]] = []
            z: list[float] = []
            for data, at, spans in _chunks(batch.column(batch.schema.get_field_index(text_col))):
                told.append(counts(data, at, spans))
                z += [model.weight[f].sum() / np.sqrt(max(len(f), 1)) for f in features(data, at, spans)]
            columns = [np.concatenate([t[k] for t in told]) if told else np.zeros(0, np.int64) for k in range(5)]
            failed = (columns[0] < MIN_WORDS) | (100 * columns[4] > MAX_REPEATED * columns[0])
            score = 1 / (1 + np.exp(-np.clip(model.slope * (np.array(z, float) + model.bias) + model.shift, -700, 700)))
            return [*columns, failed, score, ~failed & (score >= model.keep)]

        return of

    return append_struct(docs, out, KIND, make)
