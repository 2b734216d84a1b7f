"""Driver tables (TPC-H-ish parquet) -> domain relations.

The mapping is the one documented in FIXTURES.md section 2; the same rules are
written as DuckDB SQL in ``parity/adapter_sql.py`` for the oracle. A session is
one class per trainer (supplier) and calendar month; a booking is an order,
attached to the class of its earliest-shipped line.

Plan notes (scale): nation and region are fixed-size dimensions (25 and 5
rows), so they are broadcast by hint. Everything else is left to the planner:
first-line-per-order is an aggregate (``min`` of a struct), which combines
map-side, instead of a ``row_number`` window that would sort every line of an
order inside one task.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import write_once
from .schema import BOOKING, PROGRESS, REVIEWS, SESSION, TRAINER, USERS, ADMIN, Tables, conform, ntz

# Fixed value: the repeatable "now" of every fixture query.
AS_OF = "1997-01-01 00:00:00"

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Fixture:
    tables: Tables
    booking_full: DataFrame        # booking plus the driver priority column
    existing_booking: DataFrame    # booking state before AS_OF
    booking_request: DataFrame     # M8 request frame


def _email(name_col: str, domain: str):
    return F.concat(F.lower(F.regexp_replace(F.col(name_col), "#", "")), F.lit(domain))


def driver_fixture(spark: SparkSession, sf_dir: str, kept: Collection[str] = ()) -> Fixture:
    """``kept``: which of ``session``, ``booking`` and ``progress`` are written
    once and read from there. A change operator names a relation dozens of times
    (in its requests, checks and states), and each would group the lines anew."""
    rd = lambda n: read_driver(spark, sf_dir, n)
    once = lambda n, df: write_once(df) if n in kept else df
    region, nation = rd("region"), rd("nation")
    geo = F.broadcast(
        nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        .select("n_nationkey", "n_name", "r_name"))

    users = (rd("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nama"),
                     _email("c_name", "@example.test").alias("email"),
                     F.col("r_name").alias("propinsi"), F.col("n_name").alias("kota")))

    k = F.col("s_suppkey") % 3
    trainer = (rd("supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
               .select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nama"),
                       _email("s_name", "@example.test").alias("email"),
                       F.when(k == 0, "strength").when(k == 1, "yoga").otherwise("").alias("spesialisasi"),
                       F.col("r_name").alias("propinsi"), F.col("n_name").alias("kota")))

    admin = region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("nama"),
                          F.concat(F.lower("r_name"), F.lit("@admin.example.test")).alias("email"))

    line = rd("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate",
        (F.col("l_suppkey") * 1000 + (F.year("l_shipdate") - 1995) * 12
         + F.month("l_shipdate") - 1).alias("sid"))

    g = (line.groupBy("sid", "l_suppkey")
         .agg(F.min("l_shipdate").alias("start_time"), F.min("l_partkey").alias("pk")))
    size8 = F.col("p_size") % 8
    session = (g.join(rd("part"), F.col("p_partkey") == F.col("pk"))
               .select(F.col("sid").alias("id"), F.col("p_name").alias("title"),
                       F.col("p_type").alias("deskripsi"), F.col("l_suppkey").alias("trainer_id"),
                       "start_time",
                       F.when(F.col("l_suppkey") % 10 == 0, F.lit(None))
                        .otherwise(F.col("start_time") + F.expr("INTERVAL 1 HOUR")).alias("end_time"),
                       F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
                       F.when(size8 == 0, "cancelled").when(size8 == 1, "completed")
                        .when(size8 == 2, "ongoing").otherwise("scheduled").alias("status")))
    session = once("session", session)

    # Earliest line per order by (l_shipdate, l_suppkey); sid is a function of
    # both, so ties resolve to one class.
    first = (line.groupBy("l_orderkey")
             .agg(F.min(F.struct("l_shipdate", "l_suppkey", "sid")).alias("f"))
             .select("l_orderkey", F.col("f.sid").alias("sid")))
    st = F.col("o_orderstatus")
    booking_full = (rd("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
                    .select(F.col("o_orderkey").alias("id"), F.col("sid").alias("session_id"),
                            F.col("o_custkey").alias("member_id"),
                            F.when(st == "P", "Pending").when(st == "F", "Confirmed")
                             .otherwise("Cancel").alias("status"),
                            F.col("o_orderdate").alias("datetime_created"),
                            F.col("o_orderpriority").alias("priority")))
    booking_full = once("booking", booking_full)

    reviews = (booking_full.filter((F.col("status") == "Confirmed") & (F.col("id") % 2 == 0))
               .select("id", "session_id", "member_id",
                       F.substring("priority", 1, 1).cast("tinyint").alias("rating_score"),
                       F.when(F.col("id") % 5 == 0, F.lit(None))
                        .otherwise(F.expr("substr(priority, 3)")).alias("comment"),
                       "datetime_created"))

    first_booking = booking_full.groupBy(F.col("member_id").alias("m")).agg(F.min("id").alias("first_booking"))
    ev = rd("events")
    progress = (ev.join(first_booking, F.col("m") == F.col("user_id"), "left")
                .select(F.col("event_id").alias("id"), F.col("user_id").alias("member_id"),
                        F.when(F.col("event_id") % 3 == 0, F.col("first_booking")).alias("booking_id"),
                        F.col("event_type").alias("activity"),
                        F.floor("value").cast("int").alias("duration"),
                        F.col("props").alias("note"), F.col("ts").alias("jam_nyatat")))
    progress = once("progress", progress)

    tables = Tables(users=conform(users, USERS), trainer=conform(trainer, TRAINER),
                    admin=conform(admin, ADMIN), session=conform(session, SESSION),
                    booking=conform(booking_full, BOOKING), progress=conform(progress, PROGRESS),
                    reviews=conform(reviews, REVIEWS))

    as_of = ntz(AS_OF)
    created = F.col("datetime_created")
    existing = tables.booking.filter(created < as_of)
    later = tables.booking.filter(created >= as_of)
    req_cols = ["request_id", "request_ts", "actor_role", "actor_id", "session_id", "status"]
    customer = F.lit("customer")
    booking_request = (
        later.select(F.col("id").alias("request_id"), created.alias("request_ts"), customer.alias("actor_role"),
                     F.when(F.col("id") % 50 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("member_id")).alias("actor_id"),
                     F.when(F.col("id") % 41 == 0, F.lit(None).cast("bigint")).otherwise(F.col("session_id")).alias("session_id"),
                     "status")
        .unionByName(later.filter(F.col("id") % 37 == 0).select(
            (F.col("id") + 1_000_000_000).alias("request_id"), created.alias("request_ts"), customer.alias("actor_role"),
            F.col("member_id").alias("actor_id"), "session_id", F.lit("Pending").alias("status")))
        .unionByName(existing.filter(F.col("id") % 7 == 0).select(
            (F.col("id") + 2_000_000_000).alias("request_id"), as_of.alias("request_ts"), customer.alias("actor_role"),
            F.col("member_id").alias("actor_id"), "session_id", F.lit("Pending").alias("status")))
        .select(req_cols))

    return Fixture(tables=tables, booking_full=booking_full, existing_booking=existing,
                   booking_request=booking_request)


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return driver_fixture(spark, sf_dir).tables
