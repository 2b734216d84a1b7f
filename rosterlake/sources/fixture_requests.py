"""Change-request frames derived from the driver tables, one per change
operator, so every change operator runs on data that grows with the tables.

Each rule spreads the requests over the operator's outcomes (actor roles,
missing targets, blank fields, duplicates in one batch) by simple
arithmetic on existing ids; no row is dropped or sampled. The same rules are
written as DuckDB SQL in ``parity/requests_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adapter import AS_OF
from .schema import Tables, ntz

C = F.col
BIG = 1_000_000_000


def _case(key: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(d)


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def _hours(n: int) -> Column:
    return F.expr(f"INTERVAL {n} HOURS")


def _arr(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _missing(idc: Column, m: int) -> Column:
    """Every m-th target id points at no row."""
    return F.when(idc % m == 0, -idc - 1).otherwise(idc)


def status_change_requests(t: Tables) -> DataFrame:
    """M9: one request per booking plus an admin confirmation for every
    third booking, later in time."""
    b = t.booking
    k8 = C("id") % 8
    first = b.select(
        C("id").alias("request_id"), (C("datetime_created") + _days(2)).alias("request_ts"),
        _case(k8, {1: "trainer", 5: "trainer", 2: "admin", 6: "admin"}, "customer").alias("actor_role"),
        _case(k8, {3: C("member_id") + 1, 1: F.expr("session_id div 1000"), 5: F.expr("session_id div 1000") + 1,
                   2: F.lit(0).cast("bigint"), 6: F.lit(1).cast("bigint")}, C("member_id")).alias("actor_id"),
        F.when(C("id") % 13 == 0, -C("id")).otherwise(C("id")).alias("booking_id"),
        _case(C("id") % 5, {0: "Cancel", 1: "Confirmed", 2: "Pending", 3: "cancel"}, "Cancel").alias("status"))
    second = b.filter(C("id") % 3 == 0).select(
        (C("id") + BIG).alias("request_id"), (C("datetime_created") + _days(3)).alias("request_ts"),
        F.lit("admin").alias("actor_role"), F.lit(0).cast("bigint").alias("actor_id"),
        C("id").alias("booking_id"), F.lit("Confirmed").alias("status"))
    return first.unionByName(second)


def review_requests(t: Tables) -> DataFrame:
    """One review request per booking, ratings spread over the edge
    values, plus a repeat for every tenth booking an hour later."""
    b = t.booking
    rating = _case(C("id") % 8, {0: 0.0, 1: 0.5, 2: 1.0, 3: 4.5, 4: 5.0, 5: 5.5, 6: 3.0}, 4.0).cast("double")
    first = b.select(
        C("id").alias("request_id"), (C("datetime_created") + _days(1)).alias("request_ts"),
        F.when(C("id") % 9 == 0, "trainer").otherwise("customer").alias("actor_role"),
        C("member_id").alias("actor_id"),
        F.when(C("id") % 17 == 0, F.lit(0).cast("bigint")).otherwise(C("session_id")).alias("session_id"),
        rating.alias("rating_score"),
        F.when(C("id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("comment "), C("id").cast("string")))
        .alias("comment"))
    second = b.filter(C("id") % 10 == 1).select(
        (C("id") + BIG).alias("request_id"), (C("datetime_created") + _days(1) + _hours(1)).alias("request_ts"),
        F.lit("customer").alias("actor_role"), C("member_id").alias("actor_id"), C("session_id"),
        F.lit(4.0).cast("double").alias("rating_score"), F.lit("again").alias("comment"))
    return first.unionByName(second)


def progress_requests(t: Tables) -> DataFrame:
    """One request per progress row; durations as text, some of them
    '30 mins'-style or blank."""
    p = t.progress
    dur = C("duration").cast("string")
    return p.select(
        C("id").alias("request_id"), C("jam_nyatat").alias("request_ts"),
        F.when(C("id") % 11 == 0, "admin").otherwise("customer").alias("actor_role"),
        C("member_id").alias("actor_id"),
        _case(C("id") % 3, {0: C("booking_id"), 1: F.lit(0).cast("bigint")}, F.lit(None).cast("bigint"))
        .alias("booking_id"),
        F.when(C("id") % 13 == 0, F.lit("")).otherwise(C("activity")).alias("activity"),
        _case(C("id") % 7, {0: F.concat(dur, F.lit(" mins")), 1: F.lit("")}, dur).alias("duration"),
        C("note"))


def session_requests(t: Tables) -> DataFrame:
    """M5: a next-year copy of every session, with some blank titles,
    unknown trainers, default and invalid statuses."""
    s = t.session
    return s.select(
        C("id").alias("request_id"), (C("start_time") - _days(30)).alias("request_ts"),
        _case(C("id") % 6, {0: "customer", 1: "admin"}, "trainer").alias("actor_role"),
        C("trainer_id").alias("actor_id"),
        F.when(C("id") % 7 == 0, F.lit("")).otherwise(C("title")).alias("title"), "deskripsi",
        F.when(C("id") % 5 == 0, C("trainer_id") + 100000).otherwise(C("trainer_id")).alias("trainer_id"),
        (C("start_time") + _days(365)).alias("start_time"), (C("end_time") + _days(365)).alias("end_time"),
        "price",
        _case(C("id") % 4, {0: F.lit(None).cast("string"), 1: F.lit("Scheduled")}, C("status")).alias("status"))


def session_patches(t: Tables) -> DataFrame:
    """M6: one sparse patch per session (which fields are named varies),
    plus a second, later patch for every fourth session."""
    s = t.session
    k = C("id") % 6
    first = s.select(
        C("id").alias("request_id"), (C("start_time") - _days(1)).alias("request_ts"),
        F.when(C("id") % 9 == 0, "customer").otherwise("trainer").alias("actor_role"),
        C("trainer_id").alias("actor_id"),
        F.when(C("id") % 23 == 0, -C("id")).otherwise(C("id")).alias("id"),
        _case(k, {0: _arr("title"), 1: _arr("status"), 2: _arr("status"), 3: _arr("trainer_id", "price"),
                  4: _arr()}, _arr("end_time", "deskripsi")).alias("present"),
        F.upper("title").alias("title"), F.lit(None).cast("string").alias("deskripsi"),
        (C("trainer_id") + 1).alias("trainer_id"), F.lit(None).cast("timestamp_ntz").alias("start_time"),
        (C("start_time") + _hours(2)).alias("end_time"), F.lit(None).cast("decimal(10,2)").alias("price"),
        _case(k, {1: "cancelled", 2: "Cancelled"}, F.lit(None).cast("string")).alias("status"))
    second = s.filter(C("id") % 4 == 0).select(
        (C("id") + BIG).alias("request_id"), (C("start_time") - _days(1) + _hours(1)).alias("request_ts"),
        F.lit("admin").alias("actor_role"), F.lit(0).cast("bigint").alias("actor_id"), C("id"),
        _arr("title", "price").alias("present"), F.lower("title").alias("title"),
        F.lit(None).cast("string").alias("deskripsi"), F.lit(None).cast("bigint").alias("trainer_id"),
        F.lit(None).cast("timestamp_ntz").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.lit(9.99).cast("decimal(10,2)").alias("price"), F.lit(None).cast("string").alias("status"))
    return first.unionByName(second)


def _actor(idc: Column, owner: Column) -> tuple[Column, Column]:
    role = _case(idc % 5, {0: "admin", 1: "trainer"}, "customer")
    actor = F.when(idc % 7 == 0, owner + 1).otherwise(owner)
    return role.alias("actor_role"), actor.alias("actor_id")


def progress_patches(t: Tables) -> DataFrame:
    """One patch per progress row."""
    p = t.progress
    return p.select(
        C("id").alias("request_id"), (C("jam_nyatat") + _days(1)).alias("request_ts"),
        *_actor(C("id"), C("member_id")), _missing(C("id"), 19).alias("id"),
        _case(C("id") % 4, {0: _arr("activity"), 1: _arr("duration", "note"), 2: _arr()}, _arr("note"))
        .alias("present"),
        F.upper("activity").alias("activity"),
        F.when(C("id") % 3 == 0, F.lit("45 mins")).otherwise(F.lit("45")).alias("duration"),
        F.when(C("id") % 8 == 3, F.lit(None).cast("string")).otherwise(F.lit("patched")).alias("note"))


def review_patches(t: Tables) -> DataFrame:
    """One patch per review (review ids are even, so cases use id div 2)."""
    r = t.reviews
    h = F.expr("id div 2")
    return r.select(
        C("id").alias("request_id"), (C("datetime_created") + _days(5)).alias("request_ts"),
        *_actor(h, C("member_id")), _missing(C("id"), 19).alias("id"),
        _case(h % 4, {0: _arr("rating_score"), 1: _arr("comment"), 2: _arr("rating_score", "comment")}, _arr())
        .alias("present"),
        _case(h % 6, {0: F.lit(None).cast("double"), 1: F.lit(0.5), 2: F.lit(4.5)}, F.lit(3.0)).cast("double")
        .alias("rating_score"),
        F.when(h % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("edited")).alias("comment"))


def _deletes(df: DataFrame, ts: Column, owner: str, idc: Column, dup_mod: int) -> DataFrame:
    first = df.select(C("id").alias("request_id"), ts.alias("request_ts"), *_actor(idc, C(owner)),
                      _missing(C("id"), 19).alias("id"))
    second = df.filter(C("id") % dup_mod == 0).select(
        (C("id") + BIG).alias("request_id"), (ts + _hours(1)).alias("request_ts"), F.lit("admin").alias("actor_role"),
        F.lit(0).cast("bigint").alias("actor_id"), C("id"))
    return first.unionByName(second)


def progress_deletes(t: Tables) -> DataFrame:
    """M12."""
    return _deletes(t.progress, C("jam_nyatat") + _days(2), "member_id", C("id"), 6)


def review_deletes(t: Tables) -> DataFrame:
    """M15."""
    return _deletes(t.reviews, C("datetime_created") + _days(6), "member_id", F.expr("id div 2"), 6)


def session_deletes(t: Tables) -> DataFrame:
    """M7."""
    s = t.session
    first = s.select(
        C("id").alias("request_id"), C("start_time").alias("request_ts"),
        _case(C("id") % 5, {0: "admin", 1: "customer"}, "trainer").alias("actor_role"),
        F.when(C("id") % 3 == 0, C("trainer_id") + 1).otherwise(C("trainer_id")).alias("actor_id"),
        _missing(C("id"), 19).alias("id"))
    second = s.filter(C("id") % 4 == 0).select(
        (C("id") + BIG).alias("request_id"), (C("start_time") + _hours(1)).alias("request_ts"),
        F.lit("admin").alias("actor_role"), F.lit(0).cast("bigint").alias("actor_id"), C("id"))
    return first.unionByName(second)


def user_deletes(t: Tables) -> DataFrame:
    """M18."""
    u = t.users
    as_of = ntz(AS_OF)
    first = u.select(
        C("id").alias("request_id"), as_of.alias("request_ts"),
        F.when(C("id") % 3 == 1, "customer").otherwise("admin").alias("actor_role"),
        F.lit(0).cast("bigint").alias("actor_id"), _missing(C("id"), 19).alias("id"))
    second = u.filter(C("id") % 5 == 0).select(
        (C("id") + BIG).alias("request_id"), (as_of + _hours(1)).alias("request_ts"),
        F.lit("admin").alias("actor_role"), F.lit(0).cast("bigint").alias("actor_id"), C("id"))
    return first.unionByName(second)


def user_merges(t: Tables) -> DataFrame:
    """One merge per customer (blank fields, a shared new email for
    some), plus a later admin rename of every eighth customer."""
    u = t.users
    as_of = ntz(AS_OF)
    first = u.select(
        C("id").alias("request_id"), as_of.alias("request_ts"),
        _case(C("id") % 4, {0: "admin", 1: "trainer"}, "customer").alias("actor_role"),
        F.when(C("id") % 6 == 5, C("id") + 1).otherwise(C("id")).alias("actor_id"),
        _missing(C("id"), 29).alias("id"),
        F.when(C("id") % 3 == 0, F.lit("")).otherwise(F.upper("nama")).alias("nama"),
        _case(C("id") % 10, {2: F.lit("dup@example.test"), 6: F.lit("")}, C("email")).alias("email"),
        F.lit(None).cast("string").alias("propinsi"),
        F.when(C("id") % 2 == 0, F.concat(F.lit("KOTA_"), C("id").cast("string"))).otherwise(F.lit("")).alias("kota"))
    second = u.filter(C("id") % 8 == 0).select(
        (C("id") + BIG).alias("request_id"), (as_of + _hours(1)).alias("request_ts"),
        F.lit("admin").alias("actor_role"), F.lit(0).cast("bigint").alias("actor_id"), C("id"),
        F.concat(F.lit("Second "), C("id").cast("string")).alias("nama"), F.lit(None).cast("string").alias("email"),
        F.lit("P2").alias("propinsi"), F.lit(None).cast("string").alias("kota"))
    return first.unionByName(second)


def trainer_merges(t: Tables) -> DataFrame:
    """One merge per trainer."""
    tr = t.trainer
    as_of = ntz(AS_OF)
    return tr.select(
        C("id").alias("request_id"), as_of.alias("request_ts"),
        _case(C("id") % 4, {0: "admin", 1: "customer"}, "trainer").alias("actor_role"),
        F.when(C("id") % 6 == 5, C("id") + 1).otherwise(C("id")).alias("actor_id"),
        _missing(C("id"), 29).alias("id"),
        F.when(C("id") % 3 == 0, F.lit("")).otherwise(F.lower("nama")).alias("nama"),
        F.when(C("id") % 5 == 0, F.lit("shared@example.test")).otherwise(F.lit("")).alias("email"),
        F.when(C("id") % 2 == 0, F.lit("pilates")).otherwise(F.lit(None).cast("string")).alias("spesialisasi"),
        F.lit("").alias("propinsi"), F.lit(None).cast("string").alias("kota"))


def _registrations(df: DataFrame, with_role: bool, extra: tuple[Column, ...] = ()) -> DataFrame:
    new = lambda idc: F.concat(F.lit("new"), idc.cast("string"), F.lit("@example.test"))
    cols = [C("id").alias("request_id"), ntz(AS_OF).alias("request_ts")]
    if with_role:
        cols += [F.when(C("id") % 3 == 0, "customer").otherwise("admin").alias("actor_role"),
                 F.lit(0).cast("bigint").alias("actor_id")]
    return df.select(
        *cols, "nama",
        _case(C("id") % 4, {0: C("email"), 1: new(C("id")), 2: F.upper(new(C("id") - 1))}, F.lit("")).alias("email"),
        (C("id") % 5 != 0).alias("has_password"),
        F.when(C("id") % 2 == 0, F.lit(None).cast("string")).otherwise(C("propinsi")).alias("propinsi"),
        C("kota"), *extra)


def customer_registrations(t: Tables) -> DataFrame:
    """M2: one registration per customer: taken, new, new-but-clashing in
    the batch, or blank emails; some without a password."""
    return _registrations(t.users, False)


def trainer_registrations(t: Tables) -> DataFrame:
    """M3: as M2 over trainers, plus a specialty."""
    return _registrations(t.trainer, False, (F.when(C("id") % 2 == 0, C("spesialisasi")).alias("spesialisasi"),))


def admin_registrations(t: Tables) -> DataFrame:
    """M4: one admin registration per trainer row, filed by an admin or (every
    third) by a customer."""
    return _registrations(t.trainer, True).drop("propinsi", "kota")


def _mail(idc: Column) -> Column:
    return F.concat(F.lit("customer"), F.lpad(idc.cast("string"), 9, "0"), F.lit("@example.test"))


def accented(t: Tables) -> Tables:
    """The relations with accented names and mails. Of each six customers' mails
    two pairs are one mail under the collation (``É`` is e, ``Ü`` a y) and one
    differs from a pair's by ``ö`` alone; a third of the trainers share a
    customer's mail but for case and accents."""
    k = C("id") % 6
    plain = {0: _mail(C("id")), 1: F.translate(_mail(C("id") - 1), "e", "É"), 2: F.translate(_mail(C("id") - 2), "o", "ö"),
             3: F.concat(F.translate(_mail(C("id") - 3), "o", "Ö"), F.lit("  ")), 4: F.translate(_mail(C("id")), "u", "Ü")}
    users = t.users.withColumn("email", _case(k, plain, F.translate(_mail(C("id") - 1), "u", "y"))).withColumn(
        "nama", _case(C("id") % 5, {0: F.translate("nama", "eo", "éö"), 1: F.translate("nama", "uC", "üÇ"), 2: F.translate("nama", "e", "Ê")}, F.upper("nama")))
    trainer = t.trainer.withColumn("nama", F.when(C("id") % 2 == 0, F.translate("nama", "ue", "ÙÊ")).otherwise(F.translate("nama", "S", "s"))).withColumn(
        "email", F.when(C("id") % 3 == 0, F.translate(F.upper(_mail(C("id"))), "EA", "èÂ")).otherwise(C("email")))
    return t.with_(users=users, trainer=trainer)


def accented_registrations(t: Tables) -> DataFrame:
    """M2 on ``accented``: mails spelled with other accents."""
    return customer_registrations(t).withColumn("email", F.when(C("request_id") % 4 == 2, F.translate("email", "EA", "ËÀ")).otherwise(F.translate("email", "t", "T")))


def repeated(t: Tables) -> Tables:
    """The relations with a second row for some ids, of another owner: the
    state that Q1 exists to find."""
    def again(df: DataFrame, column: str | None) -> DataFrame:
        more = df.where(C("id") % 5 == 3)
        return df.unionByName(more.withColumn(column, C(column) + F.when(C("id") % 4 == 1, -1).otherwise(1)) if column else more)
    return t.with_(users=again(t.users, None), session=again(t.session, "trainer_id"), booking=again(t.booking, "member_id"),
                   progress=again(t.progress, "member_id"), reviews=again(t.reviews, "member_id"))


def user_swaps(t: Tables) -> DataFrame:
    """Customers in groups of eight hand their mails on. In each group the
    last asks first, for a new mail (in every third group for the first's mail,
    which is not free yet), then each before it asks for its neighbour's; an hour
    later every fourth asks for the mail that its successor's successor had."""
    as_of = ntz(AS_OF)
    k, group = C("id") % 8, F.floor(C("id") / 8)
    nothing = F.lit(None).cast("string")

    def ask(rid: Column, minutes: Column, mail: Column, rename: Column) -> list[Column]:
        return [rid.alias("request_id"), (as_of + F.make_dt_interval(mins=minutes.cast("int"))).alias("request_ts"),
                F.when(C("id") % 31 == 5, "trainer").otherwise("customer").alias("actor_role"), C("id").alias("actor_id"), C("id"),
                rename.alias("nama"), mail.alias("email"), nothing.alias("propinsi"), nothing.alias("kota")]
    last = F.when(group % 3 == 0, _mail(C("id") - 7)).otherwise(F.concat(F.lit("moved"), C("id").cast("string"), F.lit("@example.test")))
    first = t.users.select(*ask(C("id"), 7 - k, F.when(k == 7, last).otherwise(_mail(C("id") + 1)), F.lit("Swapped")))
    second = t.users.where("id % 4 = 1").select(*ask(C("id") + BIG, F.lit(60) + k, F.upper(_mail(C("id") + 2)), nothing))
    return first.unionByName(second)
