"""Connected components of an edge table by alternating star contractions.

Every round joins the edges with each node's smallest neighbour. Both sides of
those joins are written tables, so adaptive execution can split a hot node;
the minima are pre-aggregated before they are shuffled. No group of edges is
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import Scratch


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is
    its smallest node. Loops, repeated and reversed edges and rows with a null
    end make no difference; no edges give an empty table."""
    now = scratch.table(_ordered(edges.select("a", "b")), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = scratch.table(both.groupBy("lo").agg(F.least(F.min("lo"), F.min("hi")).alias("m")), "least")
        large = scratch.table(_ordered(now.join(least, "lo").select(F.col("m").alias("a"), F.col("hi").alias("b"))), "large")
        below = scratch.table(large.groupBy("hi").agg(F.min("lo").alias("m")), "below")
        joined = large.join(below, "hi")
        small = scratch.table(_ordered(joined.select(F.col("m").alias("a"), F.explode(F.array("lo", "hi")).alias("b"))), "small")
        after = _state(small)
        scratch.drop(now, least, large, below)
        now = small
        if after == seen:
            break
        seen = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
