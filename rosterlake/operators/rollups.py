"""Rollups (A1-A4): totals and per-key counts in one pass.

The reference runs "total" and "by key" as two concurrent queries, which can
disagree under writes. Here one ``rollup`` (grouping sets ``((key), ())``)
produces both from a single scan; partial aggregation runs map-side, so the
shuffle carries at most (#keys + 1) rows per task. A zero total row is added
and summed away, so an empty input still reports total 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col


def _zero_total(spark: SparkSession, key_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("stat_key", key_type), T.StructField("is_total", T.BooleanType()),
                           T.StructField("stat_count", T.LongType())])
    return spark.createDataFrame([(None, True, 0)], schema)


def key_stats(df: DataFrame, key: str, counted: str = "id") -> DataFrame:
    """Rows ``(stat_key, is_total, stat_count)``: one per key value plus one
    total row (``stat_key`` NULL, ``is_total`` true). ``COUNT(counted)``."""
    grouped = (df.rollup(C(key).alias("stat_key"))
               .agg(F.count(counted).alias("stat_count"), F.grouping_id().alias("g"))
               .select("stat_key", (C("g") == 1).alias("is_total"), "stat_count"))
    zero = _zero_total(df.sparkSession, df.schema[key].dataType)
    return (grouped.unionByName(zero).groupBy("stat_key", "is_total")
            .agg(F.sum("stat_count").cast("bigint").alias("stat_count")))


def user_stats(account: DataFrame) -> DataFrame:
    """A1: total accounts and count per role over the tagged union (v2); over
    a v1 ``user`` frame the same call groups its ``role`` column."""
    return key_stats(account, "role")


def booking_stats(booking: DataFrame) -> DataFrame:
    """A2: total bookings and count per status."""
    return key_stats(booking, "status")


def session_stats(session: DataFrame) -> DataFrame:
    """A3: ``(total_sessions, status)`` per status; no overall total."""
    return session.groupBy("status").agg(F.count("id").alias("total_sessions"))


def stats_document(stats: DataFrame) -> DataFrame:
    """A4: one row ``{total, distribution: [{key, count}]}`` sorted by key.
    The collected list is bounded by the key domain (an enum), not by data."""
    return stats.agg(
        F.max(F.when(C("is_total"), C("stat_count"))).alias("total"),
        F.sort_array(F.collect_list(F.when(~C("is_total"), F.struct(
            C("stat_key").alias("key"), C("stat_count").alias("count"))))).alias("distribution"))


def stats_document_rows(doc: DataFrame) -> DataFrame:
    """A4 flattened to ``(total, stat_key, stat_count)`` rows for comparison."""
    return doc.select("total", F.explode_outer("distribution").alias("d")).select(
        "total", C("d.key").alias("stat_key"), C("d.count").alias("stat_count"))
