"""Filter interaction audit: what each filter removes in every order.

A byte transducer reads the UTF-8 bytes of whole texts once. Its tables are
fixed: a byte's class, and for the state before (outside or inside a word) and
that class what is counted. The state after a byte depends on the byte's class
alone, so the pass runs on a chunk of texts at once. The word spans that it
cuts go into a hash table whose every hit is verified by length and bytes;
a text's distinct words are its entries.

Which filters a text fails is five bits; the fifth (the text occurs under a
smaller id) comes from least ids by text. Rows are counted by part and bits, and
all orders and steps follow from these counts, at most 32 a part. No text is
shuffled: equal texts meet by two 64-bit hashes and their length, as counts by
part, so a hot text is one row a part and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import Scratch, append_struct, row_chunks, text_bytes
from rosterlake.llm.spans import per_row

FILTERS = "ABCDE"
#: Fixed thresholds of the filters A to C, and the characters of D.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"

CHUNK_BYTES = 1 << 19
#: Words of more bytes are told apart by a dictionary of their bytes.
LONG = 64

# The transducer. Classes: 0 white space, 1 other ASCII, 2 capital, 3 symbol,
# 4 lead byte of a longer code point, 5 continuation byte.
_CLASS = np.ones(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = 2
_CLASS[np.frombuffer(SYMBOLS, np.uint8)] = 3
_CLASS[192:] = 4
_CLASS[128:192] = 5
#: State after a byte of each class: 0 outside, 1 inside a word.
_NEXT = np.array([0, 1, 1, 1, 1, 1], np.uint8)
_START, _END, _POINT, _CAPITAL, _SYMBOL = 1, 2, 4, 8, 16
_BY_CLASS = np.array([_POINT, _POINT, _POINT | _CAPITAL, _POINT | _SYMBOL, _POINT, 0], np.uint8)
#: What is counted, by state before and class: a word ends where white space
#: follows the inside, and starts where the inside follows the outside.
_OUTPUT = np.stack([_BY_CLASS | np.where(_NEXT == 1, _START, 0), _BY_CLASS | np.where(_NEXT == 0, _END, 0)]).astype(np.uint8)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)

COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")])


def transduce(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte counts for, and the starts and ends of words. Every text
    begins outside; its end closes a word."""
    kind = _CLASS[data]
    state = _NEXT[kind]
    before = np.zeros(len(data), np.uint8)
    before[1:] = state[:-1]
    begin = at[:-1][at[:-1] < at[1:]]
    closed = begin[1:][before[begin[1:]] == 1]
    before[begin] = 0
    output = _OUTPUT[before, kind]
    end = np.concatenate([np.flatnonzero(output & _END), closed, at[-1:][state[-1:] == 1]])
    return output, np.flatnonzero(output & _START), np.sort(end)


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The number of distinct words of each text, through the hash table."""
    lens = end - start
    limbs = [np.zeros(len(start), np.uint64) for _ in range(max(1, -(-min(int(lens.max(initial=1)), LONG) // 8)))]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    for k, limb in enumerate(limbs):
        at = np.flatnonzero((lens > 8 * k) & (lens <= LONG))
        left = np.minimum(lens[at] - 8 * k, 8)
        limb[at] = wide[start[at] + 8 * k] & (np.uint64(2**64 - 1) >> (8 * (8 - left)).astype(np.uint64))
    named: dict[bytes, int] = {}
    for i in np.flatnonzero(lens > LONG):
        limbs[0][i] = named.setdefault(data[start[i] : end[i]].tobytes(), len(named))
    code = row.astype(np.uint64) * _SPREAD + lens.astype(np.uint64)
    for limb in limbs:
        code = (code ^ limb) * _MIX
        code ^= code >> np.uint64(29)
    size = 1 << max(4, int(2 * len(start)).bit_length())
    table = np.full(size, -1, np.int64)
    slot = (code * _SPREAD >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)
    entries, left = np.zeros(rows, np.int64), np.arange(len(start))
    while len(left):
        free = left[table[slot[left]] < 0]
        table[slot[free]] = free  # the last writer of a slot owns it
        owner = table[slot[left]]
        entries += np.bincount(row[left[owner == left]], minlength=rows)
        same = (row[owner] == row[left]) & (lens[owner] == lens[left])
        for limb in limbs:
            same &= limb[owner] == limb[left]
        left = left[~same]
        slot[left] = (slot[left] + 1) & (size - 1)
    return entries


def count_texts(docs: DataFrame, text_col: str = "text", out: str = "counts") -> DataFrame:
    """``docs`` with a struct ``out`` of a text's words, distinct words, capitals
    ``[A-Z]``, code points and symbols; a null text counts like an empty one."""
    def make():
        def of(batch: pa.RecordBatch):
            data, at = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            told: list[list[np.ndarray]] = []
            for i, j in row_chunks(at, CHUNK_BYTES):
                part, upto = data[at[i] : at[j]], at[i : j + 1] - at[i]
                output, start, end = transduce(part, upto)
                row = np.searchsorted(upto, start, "right") - 1
                told.append([np.bincount(row, minlength=j - i), distinct_words(part, start, end, row, j - i),
                             *[per_row((output & bit) > 0, upto) for bit in (_CAPITAL, _POINT, _SYMBOL)]])
            return [np.concatenate([t[k] for t in told]) if told else np.zeros(0, np.int64) for k in range(len(COUNTS))]

        return of

    return append_struct(docs, out, COUNTS, make)


def failures(counts: str = "counts") -> Column:
    """Bits of the filters A to D that a row fails."""
    c = lambda name: F.col(f"{counts}.{name}")
    fails = [c("n_words") < MIN_WORDS, 100 * c("n_distinct") < MIN_DISTINCT * c("n_words"),
             100 * c("n_capitals") > MAX_CAPITALS * c("n_points"), c("n_symbols") > 0]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _by_bits(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, part_col: str, scratch: Scratch) -> DataFrame:
    """(part, bits, n, good, toxic): rows by part and failed filters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"),
                       F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.length(text).alias("n")).alias("key"))
    told = count_texts(rows).select("id", "part", "key", failures().alias("bits"))
    # The rows of an id, text and part are counted before they meet the labels.
    once = scratch.table(told.groupBy("id", "part", "key").agg(F.first("bits").alias("bits"), F.count("*").alias("n")), "rows")
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    marked = once.join(marks, "id", "left").select("id", "part", "key", "bits", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    # By text and part: all rows, and those of its least id.
    told = F.struct("id", "n", "good", "toxic")
    parts = scratch.table(marked.groupBy("key", "part").agg(
        F.first("bits").alias("bits"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")],
        *[F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_null") for c in ("n", "good", "toxic")],
        F.min(F.when(F.col("id").isNotNull(), told)).alias("first")), "texts")
    least = parts.groupBy("key").agg(F.min("first.id").alias("least"))
    held = parts.join(least, "key").withColumn("is_first", F.coalesce(F.col("first.id") == F.col("least"), F.lit(False)))
    # Rows of the text's least id, and rows without an id, fail no E.
    stay = [(F.col(f"{c}_null") + F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    kept = held.select("part", "bits", *stay)
    copies = held.select("part", (F.col("bits") + 16).alias("bits"), *[(F.col(c) - s).alias(c) for c, s in zip(("n", "good", "toxic"), stay)])
    return kept.unionByName(copies).where("n > 0").groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley (see README).

    A null text counts as empty, a null part is the empty string. Rows without
    an id never count as copies nor make any; rows that share an id and a text
    are copies of the other ids' rows only. An id with several labels is good or
    toxic if any of them says so. Other columns are not looked at. No documents
    give no rows; without labels nothing good or toxic is lost.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    cells = scratch.table(_by_bits(docs, labels, text_col, id_col, part_col, scratch), "cells")
    # Every part's cells, 32 at most, meet each step of each order.
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    place = lambda letter: F.locate(letter, F.col("filter_order"))
    bits = [(letter, 1 << i) for i, letter in enumerate(FILTERS)]
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    every = (parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
             .withColumn("bit", sum((F.when(place(x) == F.col("step"), b).otherwise(0) for x, b in bits), F.lit(0)))
             .withColumn("before", sum((F.when(place(x) < F.col("step"), b).otherwise(0) for x, b in bits), F.lit(0))))

    def total(column: str, holds) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(holds(c["bits"]), c[column]).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda b: b.bitwiseAND(bit) != 0
    gone = lambda b: b.bitwiseAND(before) != 0
    told = every.select(
        "part", "filter_order", "step", "bit", total("n", lambda b: ~fails(b) & ~gone(b)).alias("kept"),
        total("n", lambda b: fails(b) & ~gone(b)).alias("removed"), total("n", lambda b: fails(b) & gone(b)).alias("redundant"),
        total("n", lambda b: b == bit).alias("unique_fails"), total("good", lambda b: fails(b) & ~gone(b)).alias("good_lost"),
        total("toxic", lambda b: fails(b) & ~gone(b)).alias("toxic_lost"))
    told = scratch.table(told, "steps")
    shapley = told.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return told.join(shapley, ["part", "bit"]).drop("bit")
