"""M1: dense AUTO_INCREMENT ids by a total order, without a global window.

A ``row_number()`` over an un-partitioned window moves every row into one
task. Instead (the technique of ``zipWithIndex``):

1. range-partition on the order and sort inside each partition;
2. cut the lineage with a reliable checkpoint, so both passes below see the
   same rows in the same partitions even if an executor is lost;
3. count rows per partition (one number per partition reaches the driver);
4. position = rows in earlier partitions + index inside the partition,
   read from ``monotonically_increasing_id`` (partition index in the upper
   31 bits, row index in the lower 33).

The order must be total (end it with a unique column) for repeatable ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut_lineage

C = F.col
_LOW_BITS = 33


def dense_positions(df: DataFrame, order: Sequence[Column], name: str = "pos", start: int = 0,
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = ``start`` + 1-based position of the row in ``order``."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("__mid", mid)
    part = F.shiftright(C("__mid"), _LOW_BITS)
    counts = {r["p"]: r["n"] for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ranged.withColumn(name, F.lit(None).cast("bigint")).limit(0)
    offsets, acc = [], 0
    for p in range(max(counts) + 1):
        offsets.append(acc)
        acc += counts.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets]), (part + 1).cast("int"))
    index = C("__mid") - F.shiftleft(part, _LOW_BITS)
    return tagged.withColumn(name, F.lit(start).cast("bigint") + off + index + 1).drop("__mid")


def assign_ids(df: DataFrame, max_id: int | None, order: Sequence[Column], name: str = "id") -> DataFrame:
    """Ids ``max_id + 1 ..`` in ``order`` (``max_id`` None = empty table)."""
    return dense_positions(df, order, name=name, start=int(max_id or 0))


def max_id(df: DataFrame, col: str = "id") -> int:
    """Current AUTO_INCREMENT high-water mark (one scalar to the driver)."""
    v = df.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0
