"""Registered queries: each key pairs a Spark query over the driver tables
(through the adapter) with the DuckDB SQL that must return the same rows.

Spark side: ``fn(spark, sf_dir) -> DataFrame`` built from ``rosterlake``
operators. Oracle side: plain SQL over the pre-registered driver views, with
the adapter inlined as CTEs (``parity.adapter_sql``). A key without SQL is
checked on row counts only (noted where it happens).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rosterlake.operators import reports as R

from .adapter_sql import AS_OF_SQL, with_adapter

from .registry import REGISTRY, AS_OF_COL, fx, register, tables  # noqa: F401

# ------------------------------------------------------------------ reports

_J1_SELECT = """
select u.id as customer_id, u.nama as customer_name, b.id as booking_id, s.title as session_title,
       s.start_time, s.end_time, t.nama as trainer_name, b.status, b.datetime_created as booked_on
from booking b join session s on b.session_id = s.id
               join users u on b.member_id = u.id
               join trainer t on s.trainer_id = t.id
"""


@register("j01_customer_booking_history", with_adapter("", _J1_SELECT + " order by customer_id, start_time desc"))
def j01(spark, d):
    return R.customer_booking_history(tables(spark, d))


@register("j02_customer_booking_history_for", with_adapter("", _J1_SELECT + """
 where b.member_id in (select member_id from reviews) order by customer_id, start_time desc"""))
def j02(spark, d):
    t = tables(spark, d)
    return R.customer_booking_history_for(t, t.reviews.select("member_id"))


@register("j03_matched_trainer_customer", with_adapter("", """
select b.id as booking_id, s.id as session_id, s.title as session_title, s.start_time,
       t.id as trainer_id, t.nama as trainer_name, t.email as trainer_email,
       u.id as customer_id, u.nama as customer_name, u.email as customer_email,
       b.status, b.datetime_created
from booking b join session s on b.session_id = s.id
               join trainer t on s.trainer_id = t.id
               join users u on b.member_id = u.id
where b.status = 'Confirmed'"""))
def j03(spark, d):
    return R.matched_trainer_customer(tables(spark, d))


_J4_SELECT = """
select p.id as progress_id, u.id as member_id, u.nama as member_name, p.activity, p.duration,
       p.note, p.jam_nyatat as recorded_at
from progress p join users u on p.member_id = u.id"""


@register("j04_member_progress_summary", with_adapter("", _J4_SELECT + " order by recorded_at desc"))
def j04(spark, d):
    return R.member_progress_summary(tables(spark, d))


@register("j05_member_progress_summary_for", with_adapter("", _J4_SELECT + """
 where p.member_id in (select member_id from reviews) order by recorded_at desc"""))
def j05(spark, d):
    t = tables(spark, d)
    return R.member_progress_summary_for(t, t.reviews.select("member_id"))


@register("j06_my_progress", with_adapter("", """
select member_id, id as progress_id, activity, duration, note, jam_nyatat as recorded_at
from progress order by member_id, recorded_at desc"""))
def j06(spark, d):
    return R.my_progress(tables(spark, d))


_J7_SQL = with_adapter("", """
select s.id as session_id, s.title, s.start_time, s.end_time, s.price, t.nama as trainer_name,
       count(b.id) as confirmed_participants
from session s join trainer t on s.trainer_id = t.id
left join booking b on b.session_id = s.id and b.status = 'Confirmed'
group by s.id, s.title, s.start_time, s.end_time, s.price, t.nama""")


@register("j07_session_participant_counts", _J7_SQL)
def j07(spark, d):
    return R.session_participant_counts(tables(spark, d))


@register("j07_session_participant_counts_literal", _J7_SQL)
def j07_literal(spark, d):
    return R.session_participant_counts_literal(tables(spark, d))


_J8_SELECT = """
select b.id as booking_id, b.status, b.member_id as customer_id, u.nama as customer_name,
       s.id as session_id, s.title as session_title, s.trainer_id
from booking b join session s on b.session_id = s.id join users u on b.member_id = u.id"""


@register("j08_session_roster", with_adapter("", _J8_SELECT))
def j08(spark, d):
    return R.session_roster(tables(spark, d))


@register("j08_session_roster_for", with_adapter("", _J8_SELECT + " where s.id in (select session_id from reviews)"))
def j08_for(spark, d):
    t = tables(spark, d)
    return R.session_roster(t, t.reviews.select("session_id"))


_J9_FROM = """
from reviews r join session s on r.session_id = s.id
               join trainer t on s.trainer_id = t.id
               join users u on r.member_id = u.id"""


@register("j09_session_reviews_summary", with_adapter("", """
select r.id as review_id, s.id as session_id, s.title as session_title, t.nama as trainer_name,
       u.nama as customer_name, r.rating_score, r.comment""" + _J9_FROM + " order by review_id desc"))
def j09(spark, d):
    return R.session_reviews_summary(tables(spark, d))


@register("j09_session_reviews", with_adapter("", """
select s.id as session_id, s.title as session_title, r.rating_score, t.nama as trainer_name,
       u.nama as customer_name, r.comment""" + _J9_FROM + """
where s.id in (select session_id from booking where status = 'Cancel')"""))
def j09_variant(spark, d):
    t = tables(spark, d)
    return R.session_reviews(t, t.booking.filter(F.col("status") == "Cancel").select("session_id"))


@register("j10_trainer_schedule", with_adapter("", f"""
select t.id as trainer_id, t.nama as trainer_name, s.id as session_id, s.title, s.start_time,
       s.end_time, count(b.id) as confirmed_customers
from trainer t join session s on t.id = s.trainer_id
left join booking b on b.session_id = s.id and b.status = 'Confirmed'
where s.start_time > {AS_OF_SQL}
group by t.id, t.nama, s.id, s.title, s.start_time, s.end_time
order by trainer_name, start_time"""))
def j10(spark, d):
    return R.trainer_schedule(tables(spark, d), AS_OF_COL())


# J11 by its rule: sessions, and the size of each one's group of bookings that
# are anything but Confirmed; no such group counts 0.
_OTHERS = "others AS (select session_id, count(*) as n from booking where status in ('Pending', 'Cancel') group by session_id)"
_J11 = """
select session.*, case when others.n is null then 0 else others.n end as confirmed_customers
from session left join others on others.session_id = session.id"""


@register("j11_trainer_sessions", with_adapter(_OTHERS, _J11))
def j11(spark, d):
    return R.trainer_sessions(tables(spark, d))


# The forms the endpoints call: for given principals (here every third id).
@register("j06_my_progress_for", with_adapter("", """
select progress.member_id, progress.id as progress_id, activity, duration, note, jam_nyatat as recorded_at
from progress where member_id % 3 = 1"""))
def j06_for(spark, d):
    t = tables(spark, d)
    return R.my_progress(t, t.progress.where("member_id % 3 = 1").select("member_id"), ordered=False)


@register("j10_trainer_schedule_for", with_adapter(f"ahead AS (select * from session where start_time > {AS_OF_SQL} and trainer_id % 3 = 1)", """
select trainer.id as trainer_id, trainer.nama as trainer_name, ahead.id as session_id, ahead.title, ahead.start_time, ahead.end_time,
       (select count(*) from booking b where b.session_id = ahead.id and b.status = 'Confirmed') as confirmed_customers
from ahead join trainer on trainer.id = ahead.trainer_id"""))
def j10_for(spark, d):
    t = tables(spark, d)
    return R.trainer_schedule(t, AS_OF_COL(), t.trainer.where("id % 3 = 1").select("id"), ordered=False)


@register("j11_trainer_sessions_for", with_adapter(_OTHERS, _J11 + " where session.trainer_id % 3 = 1"))
def j11_for(spark, d):
    t = tables(spark, d)
    return R.trainer_sessions(t, t.trainer.where("id % 3 = 1").select("id"))


@register("j14_my_bookings_for", with_adapter("led AS (select session.id, title, start_time, nama from session, trainer where trainer.id = trainer_id)", """
select mine.member_id, mine.id as booking_id, mine.status, led.title, led.start_time, led.nama as trainer_name
from (select * from booking where member_id % 3 = 1) mine, led where led.id = mine.session_id"""))
def j14_for(spark, d):
    t = tables(spark, d)
    return R.my_bookings(t, t.users.where("id % 3 = 1").select("id"), ordered=False)


@register("j12_upcoming_sessions", with_adapter("", f"""
select s.id as session_id, s.title, s.deskripsi, s.start_time, s.end_time, s.price,
       t.nama as trainer_name, count(b.id) as confirmed_bookings
from session s join trainer t on s.trainer_id = t.id
left join booking b on b.session_id = s.id and b.status = 'Confirmed'
where s.start_time > {AS_OF_SQL}
group by s.id, s.title, s.deskripsi, s.start_time, s.end_time, s.price, t.nama"""))
def j12(spark, d):
    return R.upcoming_sessions(tables(spark, d), AS_OF_COL())


@register("j13_upcoming_sessions_member_view", with_adapter("", f"""
select s.id, s.title, s.trainer_id, t.nama as trainer_name, s.start_time, s.end_time, s.price,
       count(case when b.status = 'Confirmed' then b.id end) as confirmed_customers,
       count(b.id) as total_bookings
from session s join trainer t on s.trainer_id = t.id
left join booking b on b.session_id = s.id
where s.start_time > {AS_OF_SQL}
group by s.id, s.title, s.trainer_id, t.nama, s.start_time, s.end_time, s.price"""))
def j13(spark, d):
    return R.upcoming_sessions_member_view(tables(spark, d), AS_OF_COL())


@register("j14_my_bookings", with_adapter("", """
select b.member_id, b.id as booking_id, b.status, s.title, s.start_time, t.nama as trainer_name
from booking b join session s on b.session_id = s.id join trainer t on s.trainer_id = t.id
order by member_id, start_time desc"""))
def j14(spark, d):
    return R.my_bookings(tables(spark, d))


# ------------------------------------------------------------------ listings

@register("s03_session_catalog", with_adapter("", """
select id, title, deskripsi, trainer_id, start_time, end_time, price, status from session"""))
def s03(spark, d):
    return R.session_catalog(tables(spark, d))


@register("s04_booking_list", with_adapter("", """
select b.id, b.session_id, b.member_id, b.status, b.datetime_created,
       coalesce(b.member_name, u.nama) as member_name
from booking b left join users u on b.member_id = u.id"""))
def s04(spark, d):
    return R.booking_list(tables(spark, d))


@register("s05_progress_list", with_adapter("", """
select id, member_id, booking_id, activity, duration, note, jam_nyatat from progress"""))
def s05(spark, d):
    return R.progress_list(tables(spark, d))


@register("s06_review_list", with_adapter("", """
select id, session_id, member_id, rating_score, comment, datetime_created from reviews"""))
def s06(spark, d):
    return R.review_list(tables(spark, d))


# ------------------------------------------------------------------ rollups

from rosterlake.operators import rollups as A  # noqa: E402

_ACCOUNT_CTE = """
acct AS (select 'customer' as role, id from users union all
         select 'trainer', id from trainer union all
         select 'admin', id from admin)"""


def _stats_sql(src: str, key: str) -> str:
    return f"""
select {key} as stat_key, grouping({key}) = 1 as is_total, count(id) as stat_count
from {src} group by grouping sets (({key}), ())"""


@register("a01_user_stats", with_adapter(_ACCOUNT_CTE, _stats_sql("acct", "role")))
def a01(spark, d):
    return A.user_stats(tables(spark, d).account())


@register("a02_booking_stats", with_adapter("", _stats_sql("booking", "status")))
def a02(spark, d):
    return A.booking_stats(tables(spark, d).booking)


@register("a03_session_stats", with_adapter("", """
select count(id) as total_sessions, status from session group by status"""))
def a03(spark, d):
    return A.session_stats(tables(spark, d).session)


@register("a04_stats_document_rows", with_adapter("", """
select (select count(id) from booking) as total, status as stat_key, count(id) as stat_count
from booking group by status"""))
def a04(spark, d):
    return A.stats_document_rows(A.stats_document(A.booking_stats(tables(spark, d).booking)))


@register("a04_stats_document", None)  # nested form; rows-only check
def a04_nested(spark, d):
    return A.stats_document(A.user_stats(tables(spark, d).account()))


# ------------------------------------------------------------------ lookups

from rosterlake.operators import lookup as LK  # noqa: E402

_USER_COLS = "u.id, u.nama, u.email, u.propinsi, u.kota, u.created_at"


@register("s07_user_by_id_found", with_adapter("", f"""
select u.id as lookup_key, {_USER_COLS} from users u
where u.id in (select actor_id from booking_request)"""))
def s07_found(spark, d):
    f = fx(spark, d)
    return LK.user_by_id(f.tables, f.booking_request.select("actor_id")).found


@register("s07_user_by_id_missing", with_adapter("", """
select distinct actor_id as lookup_key from booking_request r
where actor_id is not null and not exists (select 1 from users u where u.id = r.actor_id)"""))
def s07_missing(spark, d):
    f = fx(spark, d)
    return LK.user_by_id(f.tables, f.booking_request.select("actor_id")).missing


_NAME_KEYS = """
k AS (select distinct lower(rtrim(x)) as lookup_key
      from (select upper(nama) as x from trainer union all select nama from users) q),
hit AS (select k.lookup_key, t.id, t.nama, t.email, t.spesialisasi, t.propinsi, t.kota,
               row_number() over (partition by k.lookup_key order by t.id) as rn
        from k join trainer t on lower(rtrim(t.nama)) = k.lookup_key)"""


def _name_keys(t):
    return t.trainer.select(F.upper("nama").alias("x")).unionByName(t.users.select(F.col("nama").alias("x")))


@register("s07_trainer_by_name_found", with_adapter(_NAME_KEYS, """
select lookup_key, id, nama, email, spesialisasi, propinsi, kota from hit where rn = 1"""))
def s07_name_found(spark, d):
    t = tables(spark, d)
    return LK.trainer_by_name(t, _name_keys(t)).found


@register("s07_trainer_by_name_missing", with_adapter(_NAME_KEYS, """
select lookup_key from k where lookup_key not in (select lookup_key from hit)"""))
def s07_name_missing(spark, d):
    t = tables(spark, d)
    return LK.trainer_by_name(t, _name_keys(t)).missing


_EMAIL_KEYS = """
k AS (select distinct lower(rtrim(x)) as lookup_key
      from (select upper(email) as x from users union all select email from trainer
            union all select email from admin) q),
hit AS (select k.lookup_key, u.id, u.nama, u.email,
               row_number() over (partition by k.lookup_key order by u.id) as rn
        from k join users u on lower(rtrim(u.email)) = k.lookup_key)"""


def _email_keys(t):
    return (t.users.select(F.upper("email").alias("x")).unionByName(t.trainer.select(F.col("email").alias("x")))
            .unionByName(t.admin.select(F.col("email").alias("x"))))


@register("s07_user_by_email_found", with_adapter(_EMAIL_KEYS, "select lookup_key, id, nama, email from hit where rn = 1"))
def s07_email_found(spark, d):
    t = tables(spark, d)
    return LK.user_by_email(t, _email_keys(t)).found


@register("s07_user_by_email_missing", with_adapter(_EMAIL_KEYS, """
select lookup_key from k where lookup_key not in (select lookup_key from hit)"""))
def s07_email_missing(spark, d):
    t = tables(spark, d)
    return LK.user_by_email(t, _email_keys(t)).missing


_PRINCIPALS = """
pr AS (select distinct role, id from (
         select 'customer' as role, actor_id as id from booking_request union all
         select 'trainer', trainer_id from session union all
         select 'admin', member_id from progress) q),
acct_full AS (select 'customer' as rel, id, nama, email, propinsi, kota from users union all
              select 'trainer', id, nama, email, propinsi, kota from trainer union all
              select 'admin', id, nama, email, cast(null as varchar), cast(null as varchar) from admin),
prr AS (select role, id, case when role = 'trainer' then 'trainer' when role = 'admin' then 'admin'
                              else 'customer' end as rel from pr)"""


def _principals(f):
    t = f.tables
    return (f.booking_request.select(F.lit("customer").alias("role"), F.col("actor_id").alias("id"))
            .unionByName(t.session.select(F.lit("trainer").alias("role"), F.col("trainer_id").alias("id")))
            .unionByName(t.progress.select(F.lit("admin").alias("role"), F.col("member_id").alias("id"))))


@register("s08_profile_found", with_adapter(_PRINCIPALS, """
select a.id, a.nama, a.email, a.propinsi, a.kota, p.role
from prr p join acct_full a on a.rel = p.rel and a.id = p.id"""))
def s08_found(spark, d):
    f = fx(spark, d)
    return LK.profile(_principals(f), f.tables).found


@register("s08_profile_missing", with_adapter(_PRINCIPALS, """
select p.role, p.id from prr p
where not exists (select 1 from acct_full a where a.rel = p.rel and a.id = p.id)"""))
def s08_missing(spark, d):
    f = fx(spark, d)
    return LK.profile(_principals(f), f.tables).missing


@register("s09_account_directory", with_adapter("""
acc AS (select lower(rtrim(email)) as email_key, 0 as rnk, id, 'customer' as role, nama, email from users
        union all select lower(rtrim(email)), 1, id, 'trainer', nama, email from trainer
        union all select lower(rtrim(email)), 2, id, 'admin', nama, email from admin),
ranked AS (select *, row_number() over (partition by email_key order by rnk, id) as rn from acc)""", """
select email_key, role, id, nama, email from ranked where rn = 1"""))
def s09(spark, d):
    return LK.account_directory(tables(spark, d))


# ------------------------------------------------------------------ search and paging

from rosterlake.operators import search as P  # noqa: E402

_P1 = dict(nama="0_1", email="example", sort="nama", order="DESC", page=2, limit=15)
_P1_WHERE = "where nama ilike '%0_1%' and email ilike '%example%'"
_P2 = dict(nama="r#%0", email="ignored-term", page=2, limit=7)


@register("p01_search_users", with_adapter("", f"""
select id, nama, email, propinsi, kota, created_at from users {_P1_WHERE}
order by lower(rtrim(nama)) desc nulls last, id asc limit 15 offset 15"""))
def p01(spark, d):
    return P.search_users(tables(spark, d).users, **_P1).rows


@register("p02_search_trainers", with_adapter("", """
select id, nama, email, spesialisasi as specialization, propinsi, kota from trainer
where nama ilike '%r#%0%' order by id limit 7 offset 7"""))
def p02(spark, d):
    return P.search_trainers(tables(spark, d).trainer, **_P2).rows


@register("p03_search_total_users", with_adapter("", f"select count(*) as total from users {_P1_WHERE}"))
def p03_users(spark, d):
    return P.search_users(tables(spark, d).users, **_P1).total


@register("p03_search_total_trainers", with_adapter("", "select count(*) as total from trainer where nama ilike '%r#%0%'"))
def p03_trainers(spark, d):
    return P.search_trainers(tables(spark, d).trainer, **_P2).total


@register("p04_paginate_users", with_adapter("", f"""
select id, nama, email, propinsi, kota, created_at, row_no, (row_no - 1) // 15 + 1 as page_no
from (select *, row_number() over (order by lower(rtrim(nama)) desc nulls last, id) as row_no
      from users {_P1_WHERE}) q"""))
def p04(spark, d):
    users = tables(spark, d).users.select(*P.USER_COLUMNS)
    filtered = P.matching(users, nama=_P1["nama"], email=_P1["email"])
    key = P.sort_key(filtered, "nama")
    return P.paginate(filtered, [key.desc_nulls_last(), F.col("id").asc()], limit=15)


# ------------------------------------------------------------------ M1 ids

from rosterlake.operators import ids as ID  # noqa: E402


@register("m01_assign_ids", with_adapter("", """
select request_id, request_ts,
       (select max(id) from existing_booking) + row_number() over (order by request_ts, request_id) as id
from booking_request"""))
def m01(spark, d):
    f = fx(spark, d)
    top = ID.max_id(f.existing_booking)
    req = f.booking_request.select("request_id", "request_ts")
    return ID.assign_ids(req, top, [F.col("request_ts").asc(), F.col("request_id").asc()])


# ------------------------------------------------------------------ audits

from rosterlake.operators import audit as Q  # noqa: E402


def _v(x: str) -> str:
    return f"coalesce(cast({x} as varchar), 'NULL')"


def _q_sql(rule: str, relation: str, key: str, detail: str, src: str) -> str:
    return f"select '{rule}' as rule, '{relation}' as relation, {key} as \"key\", {detail} as detail {src}"


# Fixed values, read from the DDL by hand (not from the implementation).
_RELATIONS = ("users", "trainer", "admin", "session", "booking", "progress", "reviews")
_FK = (("booking", "session_id", "session"), ("booking", "member_id", "users"), ("progress", "member_id", "users"),
       ("progress", "booking_id", "booking"), ("reviews", "session_id", "session"), ("reviews", "member_id", "users"),
       ("session", "trainer_id", "trainer"))
_REQUIRED = {"booking": "id session_id member_id status", "progress": "id member_id activity duration note",
             "reviews": "id session_id member_id rating_score", "session": "id title trainer_id start_time status",
             "users": "id nama email propinsi kota"}
_LONGEST = {"progress": {"activity": 100, "note": 200}, "session": {"title": 100, "deskripsi": 200},
            "users": {"nama": 100, "email": 100, "propinsi": 45, "kota": 45}}
_RULE_NAMES = ("primary_key", "unique_key", "foreign_key", "domain", "rating_range", "not_null", "varchar_length",
               "duplicate_review", "unconfirmed_reference", "member_name_drift")

_Q_PARTS = {
    "primary_key": [_q_sql("primary_key", r, "cast(id as varchar)", "'count=' || cast(count(*) as varchar)",
                           f"from {r} group by id having count(*) > 1") for r in _RELATIONS],
    "unique_key": [
        _q_sql("unique_key", "booking", f"concat_ws(',', {_v('session_id')}, {_v('member_id')})",
               "'count=' || cast(count(*) as varchar)", "from booking group by session_id, member_id having count(*) > 1"),
        _q_sql("unique_key", "users", "lower(rtrim(email))", "'count=' || cast(count(*) as varchar)",
               "from users group by lower(rtrim(email)) having count(*) > 1")],
    "foreign_key": [
        _q_sql("foreign_key", child, "cast(id as varchar)", f"'{col}=' || {_v(col)}",
               f"from {child} c where {col} is not null and not exists (select 1 from {parent} p where p.id = c.{col})")
        for child, col, parent in _FK],
    "domain": [
        _q_sql("domain", "booking", "cast(id as varchar)", "'status=' || status",
               "from booking where status not in ('Pending', 'Confirmed', 'Cancel')"),
        _q_sql("domain", "session", "cast(id as varchar)", "'status=' || status",
               "from session where status not in ('scheduled', 'ongoing', 'completed', 'cancelled')")],
    "rating_range": [_q_sql("rating_range", "reviews", "cast(id as varchar)", f"'rating_score=' || {_v('rating_score')}",
                            "from reviews where not (rating_score between 1 and 5)")],
    "not_null": [_q_sql("not_null", rel, "cast(id as varchar)", f"'{c}'", f"from {rel} where {c} is null")
                 for rel, cols in _REQUIRED.items() for c in cols.split()],
    "varchar_length": [_q_sql("varchar_length", rel, "cast(id as varchar)", f"'{c}'", f"from {rel} where length({c}) > {n}")
                       for rel, lim in _LONGEST.items() for c, n in lim.items()],
    "duplicate_review": [_q_sql("duplicate_review", "reviews", f"concat_ws(',', {_v('session_id')}, {_v('member_id')})",
                                "'count=' || cast(count(*) as varchar)",
                                "from reviews group by session_id, member_id having count(*) > 1")],
    "unconfirmed_reference": [
        _q_sql("unconfirmed_reference", "reviews", "cast(id as varchar)",
               f"'session_id=' || {_v('session_id')} || ',member_id=' || {_v('member_id')}",
               "from reviews r where not exists (select 1 from booking b where b.status = 'Confirmed' "
               "and b.session_id = r.session_id and b.member_id = r.member_id)"),
        _q_sql("unconfirmed_reference", "progress", "cast(id as varchar)", f"'booking_id=' || {_v('booking_id')}",
               "from progress p where booking_id is not null and not exists (select 1 from booking b "
               "where b.status = 'Confirmed' and b.id = p.booking_id and b.member_id = p.member_id)")],
    "member_name_drift": [_q_sql("member_name_drift", "booking", "cast(b.id as varchar)",
                                 "'stored=' || b.member_name || ',current=' || u.nama",
                                 "from booking b join users u on b.member_id = u.id "
                                 "where b.member_name is not null and b.member_name != u.nama")],
}


def _audit_query(rule: str, idx: int):
    fn = Q.AUDITS[rule]

    def run(spark, d):
        return fn(tables(spark, d))
    run.__name__ = f"q{idx:02d}_{rule}"
    return run


for _i, _rule in enumerate(_RULE_NAMES, start=1):
    register(f"q{_i:02d}_{_rule}", with_adapter("", "\nunion all\n".join(_Q_PARTS[_rule])))(_audit_query(_rule, _i))


@register("q00_audit_summary", with_adapter(
    "v AS (" + "\nunion all\n".join(p for r in _RULE_NAMES for p in _Q_PARTS[r]) + "),\n"
    "rules AS (select * from (values " + ", ".join(f"('{r}')" for r in _RULE_NAMES) + ") t(rule))",
    "select r.rule, count(v.rule) as n from rules r left join v on v.rule = r.rule group by r.rule"))
def q00(spark, d):
    return Q.audit_summary(Q.audit_all(tables(spark, d)))


# The clean relations break few rules, so each audit also runs over relations
# in which a fixed part of the rows is broken.
def _broken(t):
    i = F.col("id")

    def put(df, column, every, value):
        return df.withColumn(column, F.when(i % every == 3, value.cast(df.schema[column].dataType)).otherwise(F.col(column)))
    users = put(put(t.users, "kota", 90, F.lit(None)), "propinsi", 70, F.repeat(F.lit("x"), F.lit(46)))
    users = users.unionByName(t.users.where("id % 100 = 3"))
    session = put(put(t.session, "status", 80, F.lit("paused")), "trainer_id", 110, F.lit(-1))
    session = put(session, "title", 130, F.repeat(F.lit("t"), F.lit(101)))
    booking = put(put(t.booking, "status", 60, F.lit("cancel")), "member_id", 140, F.lit(-1))
    booking = put(booking, "member_name", 50, F.lit("Somebody Else"))
    progress = put(put(t.progress, "note", 120, F.lit(None)), "booking_id", 150, F.lit(-1))
    reviews = put(put(t.reviews, "rating_score", 11, F.lit(7)), "session_id", 30, F.lit(-1))
    reviews = reviews.unionByName(t.reviews.where("id % 25 = 3"))
    return t.with_(users=users, session=session, booking=booking, progress=progress, reviews=reviews)


_BROKEN = """
b_users AS (select id, nama, email, case when id % 70 = 3 then repeat('x', 46) else propinsi end as propinsi,
                   case when id % 90 = 3 then null else kota end as kota from users
            union all select id, nama, email, propinsi, kota from users where id % 100 = 3),
b_trainer AS (select * from trainer), b_admin AS (select * from admin),
b_session AS (select * replace (case when id % 80 = 3 then 'paused' else status end as status,
                                case when id % 110 = 3 then -1 else trainer_id end as trainer_id,
                                case when id % 130 = 3 then repeat('t', 101) else title end as title) from session),
b_booking AS (select * replace (case when id % 60 = 3 then 'cancel' else status end as status,
                                case when id % 140 = 3 then -1 else member_id end as member_id,
                                case when id % 50 = 3 then 'Somebody Else' else member_name end as member_name) from booking),
b_progress AS (select * replace (case when id % 120 = 3 then null else note end as note,
                                 case when id % 150 = 3 then -1 else booking_id end as booking_id) from progress),
b_reviews AS (select * replace (case when id % 11 = 3 then 7 else rating_score end as rating_score,
                                case when id % 30 = 3 then -1 else session_id end as session_id) from reviews
              union all select * from reviews where id % 25 = 3)"""


def _broken_query(rule: str, idx: int):
    def run(spark, d):
        return Q.AUDITS[rule](_broken(tables(spark, d)))
    run.__name__ = f"q{idx:02d}_{rule}_broken"
    return run


for _i, _rule in enumerate(_RULE_NAMES, start=1):
    _parts = "\nunion all\n".join(_Q_PARTS[_rule])
    register(f"q{_i:02d}_{_rule}_broken", with_adapter(_BROKEN, re.sub(
        rf"\b(from|join) ({'|'.join(_RELATIONS)})\b", r"\1 b_\2", _parts)))(_broken_query(_rule, _i))


@register("q04_role_domain", with_adapter("", """
select 'domain' as rule, 'user' as relation, cast(id as varchar) as "key",
       case when id % 2 = 0 then 'role=guest' else 'role=NULL' end as detail from users where id % 10 < 3"""))
def q04_role(spark, d):
    bad = (F.col("role") == "customer") & (F.col("id") % 10 < 3)
    v1 = _v1_user(tables(spark, d)).withColumn("role", F.when(~bad, F.col("role")).when(F.col("id") % 2 == 0, "guest"))
    return Q.role_domain(v1)


# ------------------------------------------------------------------ visibility

from rosterlake.operators import access as V  # noqa: E402

# Who sees what, read from the routes by hand (not from the
# implementation): resource, admin, trainer, customer.
_RES_VALUES = """
  ('user_list', 'all', 'none', 'none'), ('user_by_email', 'all', 'none', 'none'), ('user_delete', 'all', 'none', 'none'),
  ('booking_list', 'all', 'none', 'none'), ('progress_list', 'all', 'none', 'none'), ('review_list', 'all', 'none', 'none'),
  ('stats', 'all', 'none', 'none'), ('admin_register', 'all', 'none', 'none'),
  ('session_write', 'all', 'all', 'none'), ('matched_trainer_customer', 'all', 'all', 'none'),
  ('member_progress_summary', 'all', 'all', 'none'), ('session_roster', 'all', 'all', 'none'),
  ('customer_booking_history', 'all', 'none', 'own'), ('member_progress_summary_for', 'all', 'none', 'own'),
  ('booking_by_id', 'all', 'none', 'own'), ('user_by_id', 'all', 'none', 'own'),
  ('my_bookings', 'none', 'none', 'own'), ('my_progress', 'none', 'none', 'own'), ('own_profile', 'own', 'own', 'own'),
  ('trainer_schedule', 'all', 'own', 'all'), ('trainer_sessions', 'all', 'own', 'all'),
  ('session_reviews_summary', 'all', 'all', 'all'), ('upcoming_sessions', 'all', 'all', 'all'),
  ('session_catalog', 'all', 'all', 'all'), ('trainer_search', 'all', 'all', 'all'), ('session_reviews', 'all', 'all', 'all')"""
_ACCESS_CTES = _PRINCIPALS + f""",
res AS (select * from (values {_RES_VALUES}) t(resource, a, tr, c))"""


@register("v01_grants", with_adapter(_ACCESS_CTES, """
select p.role, r.resource,
       case p.role when 'admin' then r.a when 'trainer' then r.tr when 'customer' then r.c else 'none' end as scope
from (select distinct role from pr) p cross join res r"""))
def v01(spark, d):
    return V.grants(_principals(fx(spark, d)))


@register("v02_visible_trainer_sessions", with_adapter(_ACCESS_CTES, """
select p.role as viewer_role, p.id as viewer_id, s.id as session_id, s.trainer_id
from pr p join session s on s.trainer_id = p.id where p.role = 'trainer'"""))
def v02(spark, d):
    f = fx(spark, d)
    own = f.tables.session.select(F.col("id").alias("session_id"), "trainer_id")
    return V.visible_rows(own, _principals(f), "trainer_sessions")


@register("v03_visible_my_bookings", with_adapter(_ACCESS_CTES, """
select p.role as viewer_role, p.id as viewer_id, b.id as booking_id, b.member_id, b.status
from pr p join booking b on b.member_id = p.id where p.role = 'customer'"""))
def v03_my_bookings(spark, d):
    f = fx(spark, d)
    own = f.tables.booking.select(F.col("id").alias("booking_id"), "member_id", "status")
    return V.visible_rows(own, _principals(f), "my_bookings")


@register("v03_visible_own_profile", with_adapter(_ACCESS_CTES, """
select p.role as viewer_role, p.id as viewer_id, a.role, a.id, a.nama, a.email
from pr p join (select 'customer' as role, id, nama, email from users union all
                select 'trainer', id, nama, email from trainer union all
                select 'admin', id, nama, email from admin) a on a.id = p.id and a.role = p.role"""))
def v03_own_profile(spark, d):
    f = fx(spark, d)
    return V.visible_rows(f.tables.account().select("role", "id", "nama", "email"), _principals(f), "own_profile")


@register("v03_visible_booking_history", with_adapter(_ACCESS_CTES, """
select p.role as viewer_role, p.id as viewer_id, h.*
from pr p join (""" + _J1_SELECT + """) h on h.customer_id = p.id
where p.role = 'customer'"""))
def v03(spark, d):
    f = fx(spark, d)
    return V.visible_rows(R.customer_booking_history(f.tables, ordered=False), _principals(f),
                          "customer_booking_history")


@register("v04_visible_trainer_schedule", with_adapter(_ACCESS_CTES, f"""
select p.role as viewer_role, p.id as viewer_id, h.*
from pr p join (
  select t.id as trainer_id, t.nama as trainer_name, s.id as session_id, s.title, s.start_time,
         s.end_time, count(b.id) as confirmed_customers
  from trainer t join session s on t.id = s.trainer_id
  left join booking b on b.session_id = s.id and b.status = 'Confirmed'
  where s.start_time > {AS_OF_SQL}
  group by t.id, t.nama, s.id, s.title, s.start_time, s.end_time) h on h.trainer_id = p.id
where p.role = 'trainer'"""))
def v04(spark, d):
    f = fx(spark, d)
    return V.visible_rows(R.trainer_schedule(f.tables, AS_OF_COL(), ordered=False), _principals(f),
                          "trainer_schedule")


@register("v06_bare_id_exposure", with_adapter(_ACCESS_CTES, """
select p.role as viewer_role, p.id as viewer_id, h.*
from pr p join (""" + _J4_SELECT + """) h on h.member_id = p.id
where p.role not in ('admin', 'customer')"""))
def v06(spark, d):
    f = fx(spark, d)
    return V.bare_id_exposure(R.member_progress_summary(f.tables, ordered=False), _principals(f),
                              "member_progress_summary_for")


# ------------------------------------------------------------------ v1 loader

from rosterlake.sources.schema import split_accounts  # noqa: E402


def _v1_user(t):
    """A v1 ``user`` frame (one table with ``role``) built from the tagged union."""
    return t.account().withColumn("created_at", F.lit(None).cast("timestamp_ntz"))


@register("s02_split_accounts_users", with_adapter("", "select id, nama, email, propinsi, kota, cast(null as timestamp) as created_at from users"))
def s02_users(spark, d):
    return split_accounts(_v1_user(tables(spark, d)))["users"]


@register("s02_split_accounts_invalid_role", with_adapter("", """
select id, case when id % 2 = 0 then 'guest' end as role from users where id % 10 < 3"""))
def s02_invalid(spark, d):
    # Some v1 rows with a role outside the enum, or none.
    v1 = _v1_user(tables(spark, d))
    bad = (F.col("role") == "customer") & (F.col("id") % 10 < 3)
    return split_accounts(v1.withColumn("role", F.when(~bad, F.col("role")).when(F.col("id") % 2 == 0, "guest")))["invalid_role"]


@register("s02_split_accounts_trainer", with_adapter("", """
select id, nama, email, spesialisasi, propinsi, kota from (
  select id, nama, email, cast(null as varchar) as spesialisasi, propinsi, kota from trainer) q"""))
def s02_trainer(spark, d):
    return split_accounts(_v1_user(tables(spark, d)))["trainer"]


@register("s02_split_accounts_admin", with_adapter("", "select id, nama, email from admin"))
def s02_admin(spark, d):
    return split_accounts(_v1_user(tables(spark, d)))["admin"]


# ------------------------------------------------------------------ more keyed lookups

from rosterlake.sources import fixture_requests as RQ  # noqa: E402

from .requests_sql import REQUEST_CTES  # noqa: E402


@register("s07_session_by_id_found", with_adapter("", """
select s.id as lookup_key, s.id, s.title, s.deskripsi, s.trainer_id, s.start_time, s.end_time, s.price, s.status
from session s where s.id in (select session_id from booking_request)"""))
def s07_session_found(spark, d):
    f = fx(spark, d)
    return LK.session_by_id(f.tables, f.booking_request.select("session_id")).found


@register("s07_booking_by_id_found", with_adapter(REQUEST_CTES["status_req"], """
select b.id as lookup_key, b.id, b.session_id, b.member_id, b.status, b.datetime_created
from booking b where b.id in (select booking_id from status_req)"""))
def s07_booking_found(spark, d):
    t = tables(spark, d)
    return LK.booking_by_id(t, RQ.status_change_requests(t).select("booking_id")).found


@register("s07_booking_by_id_missing", with_adapter(REQUEST_CTES["status_req"], """
select distinct booking_id as lookup_key from status_req r
where booking_id is not null and not exists (select 1 from booking b where b.id = r.booking_id)"""))
def s07_booking_missing(spark, d):
    t = tables(spark, d)
    return LK.booking_by_id(t, RQ.status_change_requests(t).select("booking_id")).missing


@register("s07_trainer_by_id_found", with_adapter(REQUEST_CTES["session_req"], """
select t.id as lookup_key, t.id, t.nama, t.email, t.spesialisasi as specialization, t.propinsi, t.kota
from trainer t where t.id in (select trainer_id from session_req)"""))
def s07_trainer_found(spark, d):
    t = tables(spark, d)
    return LK.trainer_by_id(t, RQ.session_requests(t).select("trainer_id")).found


@register("s07_trainer_by_id_missing", with_adapter(REQUEST_CTES["session_req"], """
select distinct trainer_id as lookup_key from session_req r
where trainer_id is not null and not exists (select 1 from trainer t where t.id = r.trainer_id)"""))
def s07_trainer_missing(spark, d):
    t = tables(spark, d)
    return LK.trainer_by_id(t, RQ.session_requests(t).select("trainer_id")).missing


# ------------------------------------------------------------------ publish and read back

from rosterlake.plans.session import ensure_checkpoint_dir  # noqa: E402
from rosterlake.sources.sinks import round_trip  # noqa: E402


@register("s10_published_sessions_upcoming", with_adapter(f"ahead AS (select * from session where start_time > {AS_OF_SQL})", """
select ahead.id as session_id, ahead.title, trainer.nama as trainer_name,
       (select count(*) from booking b where b.session_id = ahead.id and b.status = 'Confirmed') as confirmed_customers
from ahead join trainer on trainer.id = ahead.trainer_id"""))
def s10(spark, d):
    import uuid
    back = round_trip(spark, f"{ensure_checkpoint_dir(spark)}/rosterlake-db/{uuid.uuid4().hex}", tables(spark, d))
    return R.trainer_schedule(back, AS_OF_COL(), ordered=False).select("session_id", "title", "trainer_name", "confirmed_customers")
