"""Helpers shared by the training-data operators.

Tables between steps live in the shared folder that ``spark.checkpoint.dir``
names, so any executor can read what another wrote. Text reaches numpy as one
byte buffer with row offsets, straight from the Arrow batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rosterlake.plans.session import ensure_checkpoint_dir

CHUNK_BYTES = 2 << 20
#: Bytes of a batch that a task gives back, about: the JVM holds each whole.
BATCH_BYTES = 1 << 20


class Scratch:
    """Parquet tables of one operator call in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rosterlake-llm/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back with the schema it had."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        # The shuffle files of the finished step go once its plan is collected.
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made by ``table`` that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def append_struct(df: DataFrame, out: str, kind: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """``df`` with a struct column ``out`` (a column of that name is replaced).

    ``make()`` runs once a task and returns a function from an Arrow batch to
    the struct's field arrays.
    """
    base = df.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, kind)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, f = to_arrow_type(kind), make()
        for b in batches:
            fields = [x if isinstance(x, pa.Array) and x.type == t.type else pa.array(x, type=t.type)
                      for x, t in zip(f(b), arrow, strict=True)]
            yield from slices(pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(fields, fields=list(arrow))], names))

    return base.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in batches of about ``BATCH_BYTES``."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one UTF-8 byte array, and row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(filled.type) else np.int32
    _, offsets, data = filled.buffers()
    if offsets is None or not len(filled):
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def codepoints_before(data: np.ndarray) -> np.ndarray:
    """For each byte offset 0..n, how many code points start before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def fold(column: str, modulus: int):
    """The contract's fold number: crc32 of the id written as text. A null id
    counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
