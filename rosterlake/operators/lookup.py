"""Keyed lookups in batch form.

Every by-key GET of the reference becomes one join of a frame of keys with a
relation: ``found`` holds the rows, ``missing`` the keys with no row (the API's
404). String keys compare by the declared collation (case, most
accents and trailing blanks ignored). When several rows share a key the one with the
lowest id wins (the reference takes ``rows[0]`` of an unordered result).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.collation import norm_key
from ..sources.schema import Tables

C = F.col

# Fixed value: login search order across the people relations.
ROLE_PRECEDENCE = ("customer", "trainer", "admin")


@dataclass(frozen=True)
class Lookup:
    found: DataFrame
    missing: DataFrame


def lookup(keys: DataFrame, table: DataFrame, on: str, cols: list[str], ci: bool = False,
           unique: bool = False) -> Lookup:
    """S7. ``keys``: first column holds the key values. ``unique=True`` when
    ``on`` is the primary key, so no first-per-key step is needed."""
    kexpr = norm_key(C(keys.columns[0])) if ci else C(keys.columns[0])
    k = keys.select(kexpr.alias("lookup_key")).where(C("lookup_key").isNotNull()).distinct()
    texpr = norm_key(C(on)) if ci else C(on)
    cand = table.select(texpr.alias("lookup_key"), *cols)
    if unique:
        found = cand.join(k, "lookup_key", "left_semi")
    else:
        # Lowest id per key as an aggregate: combines map-side, so a key
        # shared by many rows costs one partial row per task.
        # The distinct keys are exchanged anew for the semi join, so that AQE
        # can split such a key there.
        others = [c for c in cols if c != "id"]
        apart = F.pmod(F.xxhash64("lookup_key"), F.lit(1))
        found = (cand.withColumn("__apart", apart).join(k.withColumn("__apart", apart), ["lookup_key", "__apart"], "left_semi")
                 .groupBy("lookup_key").agg(F.min(F.struct("id", *others)).alias("r"))
                 .select("lookup_key", *[C(f"r.{c}").alias(c) for c in ["id", *others]]))
    missing = k.join(found.select("lookup_key"), "lookup_key", "left_anti")
    return Lookup(found=found, missing=missing)


def user_by_id(t: Tables, keys: DataFrame) -> Lookup:
    return lookup(keys, t.users, "id", ["id", "nama", "email", "propinsi", "kota", "created_at"], unique=True)


def user_by_email(t: Tables, keys: DataFrame) -> Lookup:
    return lookup(keys, t.users, "email", ["id", "nama", "email"], ci=True)


def session_by_id(t: Tables, keys: DataFrame) -> Lookup:
    return lookup(keys, t.session, "id",
                  ["id", "title", "deskripsi", "trainer_id", "start_time", "end_time", "price", "status"],
                  unique=True)


def booking_by_id(t: Tables, keys: DataFrame) -> Lookup:
    return lookup(keys, t.booking, "id", ["id", "session_id", "member_id", "status", "datetime_created"],
                  unique=True)


def trainer_by_id(t: Tables, keys: DataFrame) -> Lookup:
    tr = t.trainer.withColumnRenamed("spesialisasi", "specialization")
    return lookup(keys, tr, "id", ["id", "nama", "email", "specialization", "propinsi", "kota"], unique=True)


def trainer_by_name(t: Tables, keys: DataFrame) -> Lookup:
    """Exact (collation-equal) name match; returns the raw ``spesialisasi``
    column, unlike by-id and the list, which alias it."""
    return lookup(keys, t.trainer, "nama", ["id", "nama", "email", "spesialisasi", "propinsi", "kota"], ci=True)


def profile(principals: DataFrame, t: Tables) -> Lookup:
    """``principals(role, id)``; role trainer reads ``trainer``, admin reads
    ``admin``, anything else reads ``users``. Output keeps the caller's role."""
    acct = t.account().select(C("role").alias("a_role"), C("id").alias("a_id"), "nama", "email",
                              "propinsi", "kota")
    p = principals.select("role", "id").distinct().withColumn(
        "rel", F.when(C("role") == "trainer", "trainer").when(C("role") == "admin", "admin").otherwise("customer"))
    on = (C("rel") == C("a_role")) & (C("id") == C("a_id"))
    found = p.join(acct, on).select("id", "nama", "email", "propinsi", "kota", "role")
    missing = p.join(acct, on, "left_anti").select("role", "id")
    return Lookup(found=found, missing=missing)


def account_directory(t: Tables) -> DataFrame:
    """One account per normalised email, users before trainers before
    admins (the login search order), lowest id inside a relation."""
    rank = F.when(C("role") == "customer", 0).when(C("role") == "trainer", 1).otherwise(2)
    acct = t.account().select(norm_key("email").alias("email_key"), rank.alias("rank"), "id", "role", "nama",
                              "email")
    return (acct.groupBy("email_key").agg(F.min(F.struct("rank", "id", "role", "nama", "email")).alias("w"))
            .select("email_key", C("w.role").alias("role"), C("w.id").alias("id"), C("w.nama").alias("nama"),
                    C("w.email").alias("email")))
