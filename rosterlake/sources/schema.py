"""Declared schemas of the domain relations (S1, S2) and the Tables container.

The canonical model has three people relations (``users`` = customers,
``trainer``, ``admin``); any key crossing them is ``(role, id)``. Ids are
64-bit. ``password`` never enters a frame: loaders select declared columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enum domains from the DDL and handlers.
BOOKING_STATUSES = ("Pending", "Confirmed", "Cancel")
SESSION_STATUSES = ("scheduled", "ongoing", "completed", "cancelled")
ROLES = ("customer", "trainer", "admin")

L, S, TS = T.LongType(), T.StringType(), T.TimestampNTZType()
PRICE = T.DecimalType(10, 2)


def _schema(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


USERS = _schema(("id", L, False), ("nama", S, False), ("email", S, False),
                ("propinsi", S, False), ("kota", S, False), ("created_at", TS, True))
TRAINER = _schema(("id", L, False), ("nama", S, False), ("email", S, False),
                  ("spesialisasi", S, True), ("propinsi", S, True), ("kota", S, True))
ADMIN = _schema(("id", L, False), ("nama", S, False), ("email", S, False))
SESSION = _schema(("id", L, False), ("title", S, False), ("deskripsi", S, True),
                  ("trainer_id", L, False), ("start_time", TS, False), ("end_time", TS, True),
                  ("price", PRICE, True), ("status", S, False), ("updated_at", TS, True))
BOOKING = _schema(("id", L, False), ("session_id", L, False), ("member_id", L, False),
                  ("status", S, False), ("datetime_created", TS, True), ("member_name", S, True))
PROGRESS = _schema(("id", L, False), ("member_id", L, False), ("booking_id", L, True),
                   ("activity", S, False), ("duration", T.IntegerType(), False),
                   ("note", S, False), ("jam_nyatat", TS, True))
REVIEWS = _schema(("id", L, False), ("session_id", L, False), ("member_id", L, False),
                  ("rating_score", T.ByteType(), False), ("comment", S, True),
                  ("datetime_created", TS, True))
# v1 dump: one people table with a role column.
USER_V1 = _schema(("id", L, False), ("nama", S, False), ("email", S, False), ("role", S, False),
                  ("propinsi", S, False), ("kota", S, False), ("created_at", TS, True))
ACCOUNT = _schema(("role", S, False), ("id", L, False), ("nama", S, False), ("email", S, False),
                  ("propinsi", S, True), ("kota", S, True))

SCHEMAS: dict[str, T.StructType] = {
    "users": USERS, "trainer": TRAINER, "admin": ADMIN, "session": SESSION,
    "booking": BOOKING, "progress": PROGRESS, "reviews": REVIEWS,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: declared columns only, cast to the
    declared type; a declared column the input lacks becomes a typed NULL if
    it may be NULL and is an error if not. Extra input columns (``password``
    included) are dropped."""
    have = set(df.columns)
    lacking = [f.name for f in schema.fields if not f.nullable and f.name not in have]
    if lacking:
        raise ValueError(f"columns that may not be NULL are missing: {', '.join(lacking)}")
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    trainer: DataFrame
    admin: DataFrame
    session: DataFrame
    booking: DataFrame
    progress: DataFrame
    reviews: DataFrame
    # Largest id ever given per relation, where publication recorded it.
    high_water: Mapping[str, int] = field(default_factory=dict)

    def floor(self, relation: str) -> int:
        return int(self.high_water.get(relation, 0))

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def items(self):
        return [(name, getattr(self, name)) for name in SCHEMAS]

    def account(self) -> DataFrame:
        """Tagged union ``account(role, id, nama, email, propinsi, kota)``."""
        return account_union(self.users, self.trainer, self.admin)


def account_union(users: DataFrame, trainer: DataFrame, admin: DataFrame) -> DataFrame:
    def tag(df: DataFrame, role: str) -> DataFrame:
        return conform(df.withColumn("role", F.lit(role)), ACCOUNT)
    return tag(users, "customer").unionByName(tag(trainer, "trainer")).unionByName(tag(admin, "admin"))


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet", options: dict[str, str] | None = None) -> Tables:
    """Typed, declared-schema read of every relation stored under
    ``path/<name>``. Text formats get the declared schema, so no inference
    pass runs; ``options`` go to the reader (for CSV, say how NULL is
    written, since an empty string is a real value here). Column pruning
    reaches the scan."""
    frames = {}
    for name, schema in SCHEMAS.items():
        reader = spark.read.format(fmt).options(**(options or {}))
        if fmt != "parquet":
            reader = reader.schema(schema).option("header", "true")
        frames[name] = conform(reader.load(f"{path}/{name}"), schema)
    return Tables(**frames)


def split_accounts(user_v1: DataFrame) -> dict[str, DataFrame]:
    """v1 ``user`` (one table, ``role`` enum) -> customers, trainers,
    admins. Rows whose role is outside the domain land in ``invalid_role``
    instead of vanishing. One scan feeds the four filters."""
    role = F.col("role")
    return {
        "users": conform(user_v1.filter(role == "customer"), USERS),
        "trainer": conform(user_v1.filter(role == "trainer"), TRAINER),
        "admin": conform(user_v1.filter(role == "admin"), ADMIN),
        "invalid_role": user_v1.filter(role.isNull() | ~role.isin(*ROLES)).select("id", "role"),
    }


def ntz(value: str) -> Column:
    """A TIMESTAMP_NTZ literal that does not depend on session settings."""
    return F.lit(value).cast(TS)
