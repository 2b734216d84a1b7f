"""Toxicity scores from a linear classifier over scaled character n-grams.

Naive Bayes log-count ratios of n-gram presence come from document counts over
all training rows. Every bucket is a feature: its presence times its log-count
ratio, of either sign, shrunk smoothly where few rows tell of it, so that the
length of a clean passage around a toxic one doesn't hide it. A logistic
regression over them is fitted on a uniform sample of about ``SAMPLE_ROWS`` training rows, chosen by a hash of text and id,
so copies of a text are in or out each for itself. The sample stays in Spark:
tasks sum loss and gradient over their rows, the driver holds vectors of a
number a bucket only. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import Scratch, append_struct, row_chunks, text_bytes
from rosterlake.llm.ngrams import grams_per_row

SIZES = (4, 5, 6)
HASH_BITS = 18
#: The statistic at which a bucket counts half: chance reaches it in none of 2**18.
STRENGTH = 28.0
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
RIDGE = 1e-4
STEPS = 60
#: Bytes of text to find the buckets of at a time: working arrays take up to 50 times that.
GRAM_BYTES = 1 << 18
#: Entries of a block of the sample, and partitions that hold it.
BLOCK = 1 << 20
PARTS = 12

KIND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


@dataclass
class ToxicityModel:
    """The weight of each bucket (regression weight times scale)."""

    weight: np.ndarray
    bias: float
    threshold: float = THRESHOLD


def _active(column: pa.Array) -> Iterator[np.ndarray]:
    """The buckets that each text has, once each, where they come last."""
    data, at = text_bytes(column)
    last = np.zeros(1 << HASH_BITS, np.int64)
    for i, j in row_chunks(at, GRAM_BYTES):
        for grams in grams_per_row(data[at[i] : at[j]], at[i : j + 1] - at[i], SIZES, HASH_BITS):
            place = np.arange(len(grams))
            last[grams] = place
            yield grams[last[grams] == place]


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each bucket, and all documents, by class."""
    size = 1 << HASH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size + 1), np.int64)
        for b in batches:
            for y, grams in zip(b.column(1).to_pylist(), _active(b.column(0)), strict=True):
                seen[y, grams] += 1
                seen[y, size] += 1
        y, k = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({"toxic": pa.array(y, pa.int32()), "bucket": pa.array(k, pa.int32()), "n": pa.array(seen[y, k])})

    found = rows.mapInArrow(count, "toxic int, bucket int, n long").groupBy("bucket").agg(
        *[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]).toArrow()
    n = np.zeros((2, size + 1))
    n[:, found["bucket"].to_numpy()] = found["n0"].to_numpy(), found["n1"].to_numpy()
    return n[:, :-1], n[:, -1]


def _likelihood_ratio(n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """G statistic of presence against class, for each bucket."""
    out = np.zeros(n.shape[1])
    total, all_docs = n.sum(axis=0), docs.sum()
    for cell, row in ((n, total), (docs[:, None] - n, all_docs - total)):
        for y in (0, 1):
            expected = row * docs[y] / all_docs
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(cell[y] > 0, cell[y] * np.log(cell[y] / expected), 0)
    return 2 * out


def _scale(n: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """What a bucket's presence counts: its log-count ratio, the less the nearer
    its statistic is to what chance reaches; none is left out."""
    ratio = np.log((n[1] + 0.5) / (docs[1] + 1)) - np.log((n[0] + 0.5) / (docs[0] + 1))
    strength = np.maximum(_likelihood_ratio(n, docs), 0)
    return ratio * strength**2 / (strength**2 + STRENGTH**2)


def _gaps(rows: list[np.ndarray]) -> np.ndarray:
    """The buckets of a block's rows as bytes, one or two each in texts of some
    length: sorted within a row and put one row after another, each as its
    distance from the one before, in bytes of 255 and the rest. A row takes at
    most 2,056 bytes more than it has buckets."""
    place = np.concatenate([np.sort(f).astype(np.int64) + (k << HASH_BITS) for k, f in enumerate(rows)])
    gap = np.diff(place, prepend=0)
    last = np.cumsum(gap // 255 + 1) - 1
    out = np.full(last[-1] + 1 if len(last) else 0, 255, np.uint8)
    out[last] = gap % 255
    return out


def _from_gaps(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255] & ((1 << HASH_BITS) - 1)


def _blocks(sample: DataFrame) -> DataFrame:
    """The features of the sample's rows, in blocks of about ``BLOCK``
    entries: labels and numbers of buckets as int32 bytes, buckets as ``_gaps``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        toxic: list[int] = []
        entries = 0

        def block() -> pa.RecordBatch:
            parts = np.array(toxic, np.int32), np.array([len(f) for f in held], np.int32), _gaps(held)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["toxic", "sizes", "buckets"])

        for b in batches:
            for y, found in zip(b.column(1).to_pylist(), _active(b.column(0)), strict=True):
                held.append(found)
                toxic.append(y)
                entries += len(found)
                if entries >= BLOCK:
                    yield block()
                    held, toxic, entries = [], [], 0
        if held:
            yield block()

    return sample.mapInArrow(pack, "toxic binary, sizes binary, buckets binary")


def _sums(blocks: DataFrame, weight: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Over the blocks' rows: the log loss's gradient by bucket, and the sums
    of loss, of errors, of rows and of toxic rows."""
    size = len(weight)
    shared = blocks.sparkSession.sparkContext.broadcast((weight, bias))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        gradient, told = np.zeros(size), np.zeros(4)
        for b in batches:
            for row in zip(*(c for c in b.columns), strict=True):
                y, n, gaps = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int32, np.int32, np.uint8), strict=True))
                buckets = _from_gaps(gaps)
                upto = np.concatenate([[0], np.cumsum(weight[buckets])])[np.concatenate([[0], np.cumsum(n)])]
                z = np.diff(upto) + bias
                err = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
                gradient += np.bincount(buckets, np.repeat(err, n), minlength=size)
                told += (np.logaddexp(0, z) - y * z).sum(), err.sum(), len(y), y.sum()
        yield pa.RecordBatch.from_arrays([pa.array([gradient.tobytes()], pa.binary()), pa.array([told.tobytes()], pa.binary())], ["gradient", "told"])

    found = blocks.coalesce(PARTS).mapInArrow(part, "gradient binary, told binary").toArrow()
    shared.destroy()
    gradient, told = np.zeros(size), np.zeros(4)
    for r in zip(*found.columns, strict=True):
        gradient += np.frombuffer(r[0].as_buffer())
        told += np.frombuffer(r[1].as_buffer())
    return gradient, told


def _minimum(value: Callable, x: np.ndarray) -> np.ndarray:
    """L-BFGS: where the convex ``value`` (with gradient) is least."""
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, scale = -g, []
        for s, y in reversed(pairs):
            scale.append((s @ d) / (s @ y))
            d = d - scale[-1] * y
        d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1])) if pairs else d / max(1.0, np.linalg.norm(g))
        for (s, y), k in zip(pairs, reversed(scale), strict=True):
            d = d + (k - (y @ d) / (s @ y)) * s
        step = 1.0
        while True:
            f_new, g_new = value(x + step * d)
            if f_new <= f + 1e-4 * step * (g @ d) or step < 1e-6:
                break
            step /= 4
        s, y = step * d, g_new - g
        done = f - f_new <= 1e-4 * f
        if f_new > f:
            break
        x, f, g = x + s, f_new, g_new
        if done:
            break
        if s @ y > 0:
            pairs = [*pairs, (s, y)][-10:]
    return x


def _fit(blocks: DataFrame, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge, over the blocks' rows."""
    _, (_, _, n, toxic) = _sums(blocks, np.zeros(len(scale)), 0.0)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        gradient, told = _sums(blocks, x[:-1] * scale, float(x[-1]))
        return told[0] / n + RIDGE / 2 * (x[:-1] @ x[:-1]), np.append(gradient * scale / n + RIDGE * x[:-1], told[1] / n)

    x = np.append(np.zeros(len(scale)), np.log((toxic + 0.5) / (n - toxic + 0.5)))
    x = _minimum(value, x) if n else x
    return x[:-1] * scale, float(x[-1])


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> ToxicityModel:
    """Learn from rows (text, 0/1 label). Rows without a label or text teach
    nothing; with one class only, every score is that class's share. The sample
    goes by text and ``id_col``, or without that by text and row number."""
    scratch = Scratch(labelled.sparkSession, "toxicity")
    rows = scratch.table(labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
                         .select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"),
                                 F.xxhash64(text_col, id_col if id_col in labelled.columns else F.monotonically_increasing_id()).alias("pick")), "rows")
    n, docs = _counts(rows.drop("pick"))
    if not docs.all():
        scratch.drop(rows)
        share = (docs[1] + 0.5) / (docs.sum() + 1)
        return ToxicityModel(np.zeros(1 << HASH_BITS), float(np.log(share / (1 - share))))
    share = min(1.0, SAMPLE_ROWS / docs.sum())
    sample = rows.where(F.pmod("pick", F.lit(1 << 20)) < int(share * (1 << 20))).select("text", "toxic")
    blocks = scratch.table(_blocks(sample.repartition(PARTS)), "blocks")
    scratch.drop(rows)
    weight, bias = _fit(blocks, _scale(n, docs))
    scratch.drop(blocks)
    return ToxicityModel(weight, bias)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out``: score (0 to 1) and predicted. Null and
    empty texts have no features: their score is the model's bias alone. Only
    the text is looked at; repeated rows score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def of(batch: pa.RecordBatch):
            total = np.array([model.weight[f].sum() for f in _active(batch.column(batch.schema.get_field_index(text_col)))])
            p = 1 / (1 + np.exp(-np.clip(total + model.bias, -700, 700)))
            return [pa.array(p, pa.float64()), pa.array((p >= model.threshold).astype(np.int32))]

        return of

    return append_struct(docs, out, KIND, make)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, text, toxic): documents with a label; of several labels of an id the
    largest holds. The join is a merge join at every size, so that labels need
    not fit anywhere as a whole."""
    one = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__toxic"))
    return docs.select(id_col, text_col).join(one.hint("merge"), id_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col("__toxic").alias("toxic"))
