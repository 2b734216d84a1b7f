"""Data-quality audits derived from the DDL and the handlers' rules (Q1-Q10).

Every rule returns violations as ``(rule, relation, key, detail)`` rows;
``audit_summary`` counts them per rule, zeros included. Plans: key rules are
group-bys on the key alone (partial counts map-side, only keys shuffled);
foreign keys are left-anti joins of the child's non-null values against the
parent's ids; column rules (NOT NULL, lengths) unpivot with ``stack`` so each
relation is scanned once per rule with only the needed columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collation import norm_key
from ..sources.schema import BOOKING_STATUSES, ROLES, SESSION_STATUSES, Tables

C = F.col

# Fixed values from the DDL.
NOT_NULL = {
    "booking": ("id", "session_id", "member_id", "status"),
    "progress": ("id", "member_id", "activity", "duration", "note"),
    "reviews": ("id", "session_id", "member_id", "rating_score"),
    "session": ("id", "title", "trainer_id", "start_time", "status"),
    "users": ("id", "nama", "email", "propinsi", "kota"),
}
VARCHAR_LIMITS = {
    "progress": {"activity": 100, "note": 200},
    "session": {"title": 100, "deskripsi": 200},
    "users": {"nama": 100, "email": 100, "propinsi": 45, "kota": 45},
}
# (child relation, column, parent relation); the parent column is ``id``.
FOREIGN_KEYS = (
    ("booking", "session_id", "session"),
    ("booking", "member_id", "users"),
    ("progress", "member_id", "users"),
    ("progress", "booking_id", "booking"),
    ("reviews", "session_id", "session"),
    ("reviews", "member_id", "users"),
    ("session", "trainer_id", "trainer"),
)
RULES = ("primary_key", "unique_key", "foreign_key", "domain", "rating_range", "not_null", "varchar_length",
         "duplicate_review", "unconfirmed_reference", "member_name_drift")
PK_RELATIONS = ("users", "trainer", "admin", "session", "booking", "progress", "reviews")


def _out(df: DataFrame, rule: str, relation: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(relation).alias("relation"),
                     key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _s(c: str | Column) -> Column:
    return F.coalesce((C(c) if isinstance(c, str) else c).cast("string"), F.lit("NULL"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _dupes(df: DataFrame, rule: str, relation: str, keys: list[Column]) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    g = (df.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("n"))
         .filter(C("n") > 1))
    key = C(names[0]) if len(names) == 1 else F.concat_ws(",", *[_s(n) for n in names])
    return _out(g, rule, relation, key, F.concat(F.lit("count="), C("n")))


def primary_keys(t: Tables) -> DataFrame:
    """Q1: ids that occur more than once."""
    return _union([_dupes(getattr(t, r), "primary_key", r, [C("id")]) for r in PK_RELATIONS])


def unique_keys(t: Tables) -> DataFrame:
    """Q2: UNIQUE booking(session_id, member_id) and user(email), the email
    compared case- and trailing-space-insensitively."""
    return _union([_dupes(t.booking, "unique_key", "booking", [C("session_id"), C("member_id")]),
                   _dupes(t.users, "unique_key", "users", [norm_key("email")])])


def foreign_keys(t: Tables) -> DataFrame:
    """Q3: non-null child values with no parent row (NULL passes). Children
    sharing a parent are unioned first, so each parent's ids are shuffled
    once for one anti join (users serves three foreign keys)."""
    frames = []
    for parent in dict.fromkeys(p for _, _, p in FOREIGN_KEYS):
        kids = [(child, column) for child, column, p in FOREIGN_KEYS if p == parent]
        c = _union([getattr(t, child).filter(C(column).isNotNull()).select(
            F.lit(child).alias("child"), C("id"), F.lit(column).alias("column"), C(column).alias("fk"))
            for child, column in kids])
        p = getattr(t, parent).select(C("id").alias("pk"))
        # left join + IS NULL rather than left_anti: Catalyst pushes an anti
        # join below the union (one join, one parent shuffle, per child); an
        # outer join stays above it. Same rows: only unmatched ones survive.
        bad = c.join(p, C("fk") == C("pk"), "left").filter(C("pk").isNull())
        frames.append(bad.select(F.lit("foreign_key").alias("rule"), C("child").alias("relation"),
                                 C("id").cast("string").alias("key"),
                                 F.concat(C("column"), F.lit("="), _s("fk")).alias("detail")))
    return _union(frames)


def role_domain(user_v1: DataFrame) -> DataFrame:
    """Q4 on a v1 ``user`` table: a role outside its enum (a missing one too:
    the column may not be NULL)."""
    bad = user_v1.filter(C("role").isNull() | ~C("role").isin(*ROLES))
    return _out(bad, "domain", "user", C("id"), F.concat(F.lit("role="), _s("role")))


def domains(t: Tables) -> DataFrame:
    """Q4: enum columns holding a value outside their domain."""
    b = t.booking.filter(~C("status").isin(*BOOKING_STATUSES))
    s = t.session.filter(~C("status").isin(*SESSION_STATUSES))
    return _union([_out(b, "domain", "booking", C("id"), F.concat(F.lit("status="), C("status"))),
                   _out(s, "domain", "session", C("id"), F.concat(F.lit("status="), C("status")))])


def rating_range(t: Tables) -> DataFrame:
    """Q5: rating_score outside 1..5."""
    r = t.reviews.filter(~C("rating_score").between(1, 5))
    return _out(r, "rating_range", "reviews", C("id"), F.concat(F.lit("rating_score="), _s("rating_score")))


def _column_rules(t: Tables, rules: tuple[str, ...]) -> DataFrame:
    """NOT NULL (Q6) and VARCHAR length (Q7) checks, one scan per relation:
    every check becomes a (rule, column, flag) item of one ``stack``."""
    frames = []
    for rel in dict.fromkeys([*NOT_NULL, *VARCHAR_LIMITS]):
        items = []
        if "not_null" in rules:
            items += [("not_null", c, C(c).isNull()) for c in NOT_NULL.get(rel, ())]
        if "varchar_length" in rules:
            items += [("varchar_length", c, F.coalesce(F.char_length(c) > n, F.lit(False)))
                      for c, n in VARCHAR_LIMITS.get(rel, {}).items()]
        if not items:
            continue
        args = ", ".join(f"'{r}', '{c}', __f{i}" for i, (r, c, _) in enumerate(items))
        flagged = getattr(t, rel).select("id", *[cond.alias(f"__f{i}") for i, (_, _, cond) in enumerate(items)])
        u = (flagged.selectExpr("id", f"stack({len(items)}, {args}) as (rule, col, flag)").filter(C("flag"))
             .select("rule", F.lit(rel).alias("relation"), C("id").cast("string").alias("key"),
                     C("col").alias("detail")))
        frames.append(u)
    return _union(frames)


def not_null(t: Tables) -> DataFrame:
    """Q6: NULL in a NOT NULL column; detail names the column."""
    return _column_rules(t, ("not_null",))


def varchar_lengths(t: Tables) -> DataFrame:
    """Q7: values longer than the declared VARCHAR length."""
    return _column_rules(t, ("varchar_length",))


def duplicate_reviews(t: Tables) -> DataFrame:
    """Q8: more than one review per (session, member); only code prevents it."""
    return _dupes(t.reviews, "duplicate_review", "reviews", [C("session_id"), C("member_id")])


def unconfirmed_references(t: Tables) -> DataFrame:
    """Q9: a review without a Confirmed booking of its member for its session,
    and a progress row whose booking is not a Confirmed booking of its member."""
    conf = t.booking.filter(C("status") == "Confirmed")
    pairs = conf.select(C("session_id").alias("c_sid"), C("member_id").alias("c_mid"))
    r = t.reviews.join(pairs, (C("session_id") == C("c_sid")) & (C("member_id") == C("c_mid")), "left_anti")
    owned = conf.select(C("id").alias("c_bid"), C("member_id").alias("c_mid"))
    p = (t.progress.filter(C("booking_id").isNotNull())
         .join(owned, (C("booking_id") == C("c_bid")) & (C("member_id") == C("c_mid")), "left_anti"))
    return _union([
        _out(r, "unconfirmed_reference", "reviews", C("id"),
             F.concat(F.lit("session_id="), _s("session_id"), F.lit(",member_id="), _s("member_id"))),
        _out(p, "unconfirmed_reference", "progress", C("id"), F.concat(F.lit("booking_id="), _s("booking_id")))])


def member_name_drift(t: Tables) -> DataFrame:
    """Q10: a stored ``booking.member_name`` that differs from the customer's
    current name (written once at booking; profile edits never update it)."""
    u = t.users.select(C("id").alias("u_id"), C("nama").alias("u_nama"))
    d = (t.booking.filter(C("member_name").isNotNull()).join(u, C("member_id") == C("u_id"))
         .filter(C("member_name") != C("u_nama")))
    return _out(d, "member_name_drift", "booking", C("id"),
                F.concat(F.lit("stored="), C("member_name"), F.lit(",current="), C("u_nama")))


AUDITS = {
    "primary_key": primary_keys, "unique_key": unique_keys, "foreign_key": foreign_keys, "domain": domains,
    "rating_range": rating_range, "not_null": not_null, "varchar_length": varchar_lengths,
    "duplicate_review": duplicate_reviews, "unconfirmed_reference": unconfirmed_references,
    "member_name_drift": member_name_drift,
}


def audit_all(t: Tables) -> DataFrame:
    """Every rule; NOT NULL and lengths share one scan per relation."""
    fused = {"not_null", "varchar_length"}
    return _union([_column_rules(t, tuple(fused))] + [fn(t) for r, fn in AUDITS.items() if r not in fused])


def audit_summary(violations: DataFrame) -> DataFrame:
    """``(rule, n)`` for every rule, 0 where nothing was found. The rule list
    is a fixed literal (10 rows), so the right side of the join is bounded."""
    spark = violations.sparkSession
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    counts = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return (rules.join(counts, "rule", "left")
            .select("rule", F.coalesce(C("n"), F.lit(0).cast("bigint")).alias("n")))
