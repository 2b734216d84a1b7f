"""Token ids in files of canonical length-limited Huffman blocks.

Format, a folder of three Parquet tables:

``code``    token, length: the code lengths. Codes are canonical (shorter
            first, equal lengths by token), so the lengths are the code.
``blocks``  one row an independent block of whole documents: part, block,
            doc_ids, doc_tokens, n_tokens, checkpoints (the bit offset of
            every ``STEP``-th token) and bits (most significant bit first).
``parts``   part, n_tokens: tokens in each part, parts in ascending order.

Lengths come from counts over all documents by package-merge, at most
``MAX_BITS``. Decoding looks up ``MAX_BITS`` bits in a table and walks all
checkpoints of a block side by side.

Parts are ranges of (id, content), so ids ascend over the parts and equal ids
may still be split between parts. Nothing but the counts of the vocabulary
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import Scratch, text_bytes, row_chunks
from rosterlake.llm.tokens import encoder

MAX_BITS = 18
STEP = 256
BLOCK_TOKENS = 1 << 20
PART_BYTES = 32 << 20


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Package-merge: optimal lengths of at most ``limit`` bits; 0 where the
    count is 0. One symbol alone gets one bit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of the length limit")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    leaf = np.arange(len(order))
    # Each level holds packages of the level below merged with the leaves;
    # ``levels`` keeps, for the merged order, the leaf index or -1.
    levels, packed = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packed])
        rank = np.argsort(both, kind="stable")
        levels.append(np.concatenate([leaf, np.full(len(packed), -1)])[rank])
        merged = both[rank]
        even = len(merged) // 2 * 2
        packed = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for level in reversed(levels):
        first = level[:take]
        depth[first[first >= 0]] += 1
        take = 2 * int((first < 0).sum())
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol from the lengths alone."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    step = lengths[order]
    width = int(step.max()) if len(step) else 0
    space = np.uint64(1) << (width - step).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(space)[:-1]]).astype(np.uint64)
    codes[order] = first >> (width - step).astype(np.uint64)
    return codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream and the bit offset of every ``STEP``-th token."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids]
    end = np.cumsum(size)
    start = end - size
    word = start >> 5
    # A token's bits lie in the 64 bits from its word on; tokens of a word
    # don't overlap, so their sum is the bits of both words.
    window = codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    total = np.add.reduceat(window, first)
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    out[word[first]] += total >> np.uint64(32)
    out[word[first] + 1] += total & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], start[::STEP].astype(np.int64)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length of every ``MAX_BITS``-bit prefix."""
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = int(lengths[order].max()) if len(order) else 0
    span = 1 << (MAX_BITS - lengths[order])
    # A lone symbol or a code that leaves room: prefixes beyond are unused.
    symbol, size = np.zeros(1 << MAX_BITS, np.int32), np.ones(1 << MAX_BITS, np.int64)
    flat = np.repeat(order, span)
    symbol[: len(flat)], size[: len(flat)] = flat, lengths[flat]
    assert width <= MAX_BITS and (not len(order) or int(codes[order[0]]) == 0)
    return symbol, size


def decode_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``n`` ids, all checkpoints walked at once."""
    if not n:
        return np.zeros(0, np.uint32)
    symbol, size = table
    words = np.frombuffer(bits + b"\0" * (12 - len(bits) % 4), ">u4").astype(np.uint64)
    at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), STEP), np.uint32)
    tail = n - (len(checkpoints) - 1) * STEP
    for k in range(min(STEP, n)):
        if k == tail:
            at = at[:-1]
            if not len(at):
                break
        w = at >> 5
        window = words[w] << np.uint64(32) | words[w + 1]
        prefix = (window << (at & 31).astype(np.uint64)) >> np.uint64(64 - MAX_BITS)
        out[: len(at), k] = symbol[prefix]
        at = at + size[prefix]
    return out.reshape(-1)[:n]


def write_ids(docs: DataFrame, folder: str, tokenizer: Callable[[], str], vocabulary: int = 1 << 16, end_id: int = 2,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, write the files.

    A null text is empty. Null ids come first; repeated ids are documents of
    their own, in the order of their contents. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer())
        for b in batches:
            data, at = text_bytes(b.column(1))
            for i, j in row_chunks(at):
                flat, sizes = pieces.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                stops = np.cumsum(sizes)
                flat = np.insert(flat, stops, end_id).astype(narrow)
                stops = np.concatenate([[0], stops + np.arange(1, j - i + 1)]) * flat.itemsize
                ids = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], ["doc_id", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, np.int64)
        for b in batches:
            _, raw_at, raw = b.column(0).buffers()
            span = np.frombuffer(raw_at, np.int32)[b.column(0).offset :][[0, b.num_rows]]
            seen += np.bincount(np.frombuffer(raw, np.uint8)[span[0] : span[1]].view(narrow), minlength=vocabulary)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"token": pa.array(used, pa.int32()), "n": pa.array(seen[used], pa.int64())})

    scratch = Scratch(spark, "token-ids")
    encoded = scratch.table(source.mapInArrow(ids_of, f"doc_id {kind}, ids binary").withColumn("tie", F.xxhash64("ids")), "ids")
    counted = encoded.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[counted["token"]] = counted["n"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(t), int(lengths[t])) for t in used], "token int, length int").coalesce(1).write.parquet(f"{folder}/code")
    codes = canonical(lengths)
    total_bits = int((counts * lengths).sum())
    parts = max(1, -(-total_bits // (8 * PART_BYTES)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bits // (8 << 20))))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, names, sizes, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def emit(id_kind: pa.DataType) -> pa.RecordBatch:
            bits, marks = encode_bits(np.concatenate(held).astype(np.int64), codes, lengths)
            row = {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([names], pa.list_(id_kind)),
                   "doc_tokens": pa.array([sizes], pa.list_(pa.int64())), "n_tokens": pa.array([total], pa.int64()),
                   "checkpoints": pa.array([marks], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary())}
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(raw.as_py(), narrow)
                if sizes and total + len(ids) > BLOCK_TOKENS:
                    yield emit(b.column(0).type)
                    block, held, names, sizes, total = block + 1, [], [], [], 0
                held.append(ids)
                names.append(doc)
                sizes.append(len(ids))
                total += len(ids)
            last = b.column(0).type
        if sizes:
            yield emit(last)

    ordered = encoded.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    (ordered.mapInArrow(blocks, f"part int, block int, doc_ids array<{kind}>, doc_tokens array<long>, n_tokens long, checkpoints array<long>, bits binary")
     .write.option("compression", "uncompressed").parquet(f"{folder}/blocks"))
    scratch.drop(encoded)
    spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{folder}/parts")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) from the files alone; ``start`` counts the ids of
    all documents before."""
    code = spark.read.parquet(f"{folder}/code").toPandas()
    lengths = np.zeros(int(code["token"].max()) + 1 if len(code) else 1, np.int64)
    lengths[code["token"]] = code["length"]
    stored = spark.read.parquet(f"{folder}/blocks")
    id_kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    # One row a part: the running sum is over as many rows as there are files.
    offsets = spark.read.parquet(f"{folder}/parts").selectExpr(
        "part", "sum(n_tokens) over (order by part rows between unbounded preceding and current row) - n_tokens as part_start")
    starts = (stored.select("part", "block", "n_tokens")
              .selectExpr("part", "block", "sum(n_tokens) over (partition by part order by block rows between unbounded preceding and current row) - n_tokens as before")
              .join(offsets, "part").selectExpr("part", "block", "part_start + before as block_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for r in range(b.num_rows):
                names, sizes, n, marks, bits, start = (b.column(c)[r] for c in ("doc_ids", "doc_tokens", "n_tokens", "checkpoints", "bits", "block_start"))
                ids = decode_bits(bits.as_py(), np.array(marks.as_py(), np.int64), n.as_py(), table).astype("<u4")
                sizes = np.array(sizes.as_py(), np.int64)
                end = np.cumsum(sizes)
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(start.as_py() + end - sizes, pa.int64()),
                     pa.array([raw[4 * (e - s) : 4 * e] for s, e in zip(sizes, end, strict=True)], pa.binary())], ["doc_id", "start", "ids"])

    return stored.join(starts, ["part", "block"]).select("doc_ids", "doc_tokens", "n_tokens", "checkpoints", "bits", "block_start").mapInArrow(
        decode, f"doc_id {id_kind}, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: Callable[[], str], **options) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = Scratch(docs.sparkSession, "token-ids").path("files")
    write_ids(docs, folder, tokenizer, **options)
    return read_ids(docs.sparkSession, folder)
