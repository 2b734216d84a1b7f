"""Language identification by error-correcting output codes.

Every language has a codeword of ``BITS`` bits, or of ``BITS_PER_DOUBLING`` for
each doubling of their number where that is more. For each bit a binary n-gram
classifier separates the languages that have the bit from those that don't:
its weights are log-odds of n-gram presence, from document counts over all
training rows. A text gets a margin per bit; decoding weighs each bit by the
logistic loss of its margin and takes the codeword of least total loss. A
small difference to the second codeword flags the text as ambiguous.

What reaches the driver is the languages and a table of counts, languages by
buckets, of ``GROUP`` languages at a time, however large the corpus is: a bit's
classifier needs sums over languages only. Any number of languages is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import Scratch, append_struct, row_chunks, text_bytes
from rosterlake.llm.ngrams import grams_per_row

SIZES = (1, 2, 3)
HASH_BITS = 13
BITS = 15
BITS_PER_DOUBLING = 4
GROUP = 256
#: Codewords of up to so many languages are the best of many draws.
COMPARED = 512
AMBIGUOUS = 0.6
UNDETERMINED = "und"

KIND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def codewords(n: int, bits: int | None = None, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1, far apart in Hamming distance, every column with
    both signs (for n > 1): the best of many random draws. Beyond ``COMPARED``
    rows the first draw of distinct rows does: rows get longer with n."""
    bits = bits or max(BITS, BITS_PER_DOUBLING * (n - 1).bit_length())
    rng, best, far = np.random.default_rng(seed), np.ones((max(n, 1), bits)), -1
    for _ in range(400 if n > 1 else 0):
        code = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        if n > COMPARED:
            if len(np.unique(code, axis=0)) == n:
                return code
            continue
        apart = (bits - code @ code.T) / 2
        least = (apart + np.eye(n) * bits).min()
        if least > far:
            best, far = code, least
    if n > 1 and far < 0:
        best = np.where((np.arange(n)[:, None] >> (np.arange(bits) % max(1, int(n - 1).bit_length()))) & 1, 1.0, -1.0)
    return best


@dataclass
class LanguageModel:
    """Codewords of the learned languages and the bits' classifiers."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: float = 1.0

    def losses(self, present: np.ndarray) -> np.ndarray:
        """Total logistic loss of every codeword, from a matrix (texts, buckets)
        of n-gram presence."""
        n = np.maximum(present.sum(axis=1, keepdims=True), 1)
        margin = (present @ self.weights) / np.sqrt(n) * self.scale + self.bias
        return np.stack([np.logaddexp(0, -margin * word).sum(axis=1) for word in self.code], axis=1)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _presence(batch_text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, at = text_bytes(batch_text)
    for i, j in row_chunks(at):
        own, rel = data[at[i] : at[j]], at[i : j + 1] - at[i]
        rows = grams_per_row(own, rel, SIZES, HASH_BITS)
        for p in range(0, j - i, 256):
            q = min(j - i, p + 256)
            block = np.zeros((q - p, 1 << HASH_BITS), np.float32)
            for r in range(q - p):
                block[r, next(rows)] = 1
            yield i + p, i + q, block


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from every row with a label and a letter.

    Null labels and texts without a letter teach nothing. With no usable row
    the model knows no language and predicts ``und``.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & has_letter(text_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for name, total in seen.items():
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(used), "bucket": pa.array(used, pa.int32()), "n": pa.array(total[used].astype(np.int64))})
            seen.clear()

        for b in batches:
            lang = np.array(b.column(0).to_pylist(), dtype=object)
            for i, j, block in _presence(b.column(1)):
                for name in set(lang[i:j]):
                    own = block[lang[i:j] == name]
                    total = seen.setdefault(name, np.zeros((1 << HASH_BITS) + 1))
                    total[:-1] += own.sum(axis=0)
                    total[-1] += len(own)
                if len(seen) > GROUP:
                    yield from counted()
        yield from counted()

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = Scratch(labelled.sparkSession, "languages").table(counts, "counts")
    # The last place counts a language's rows.
    languages = sorted(r[0] for r in counts.where(F.col("bucket") == 1 << HASH_BITS).select("lang").collect())
    code = codewords(len(languages)) if languages else np.ones((0, BITS))
    bits = code.shape[1]
    weights, bias = np.zeros((1 << HASH_BITS, bits), np.float32), np.zeros(bits)
    sums = {s: np.zeros((1 << HASH_BITS, bits)) for s in (1, -1)}
    for first in range(0, len(languages), GROUP):
        own = languages[first : first + GROUP]
        part = counts.where(F.col("lang").between(own[0], own[-1])).toPandas()
        n = np.zeros((len(own), (1 << HASH_BITS) + 1))
        n[part["lang"].map({x: k for k, x in enumerate(own)}), part["bucket"]] = part["n"]
        # Every language counts alike: rates are averaged over the languages
        # of a side, so a frequent language doesn't drown a rare one.
        rate = (n[:, :-1] + 0.5) / (n[:, -1:] + 1)
        for s, total in sums.items():
            total += rate.T @ (code[first : first + GROUP] == s)
    for b in range(bits if languages else 0):
        yes, no = ((code[:, b] == s).sum() for s in (1, -1))
        if not (yes and no):
            bias[b] = 3.0 * code[0, b]
            continue
        weights[:, b] = np.log((sums[1][:, b] / yes) / (sums[-1][:, b] / no))
    return LanguageModel(languages, code, weights, bias)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: lang, score (0 to 1, the share of the
    best codeword) and ambiguous. Null texts and texts without a letter are
    ``und`` with score 0 and not ambiguous; only the text is looked at."""
    marked = docs.withColumn("__letter", has_letter(text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def of(batch: pa.RecordBatch):
            letter = np.array(batch.column(batch.schema.get_field_index("__letter")).to_pylist(), bool)
            lang = np.full(batch.num_rows, UNDETERMINED, object)
            score, ambiguous = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if model.languages:
                for i, j, block in _presence(batch.column(batch.schema.get_field_index(text_col))):
                    loss = model.losses(block)
                    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
                    share = share.max(axis=1) / share.sum(axis=1)
                    own = letter[i:j]
                    lang[i:j] = np.where(own, np.array(model.languages, object)[loss.argmin(axis=1)], UNDETERMINED)
                    score[i:j] = np.where(own, share, 0)
                    ambiguous[i:j] = own & (share < AMBIGUOUS)
            return [pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)]

        return of

    return append_struct(marked, out, KIND, make).drop("__letter")
