"""Registered change-operator queries (M2-M18) and their oracle SQL.

Each operator is registered as ``<id>_rejected`` (request_id, reason),
``<id>_accepted`` and, where the new state is the interesting output,
``<id>_state``. The oracle SQL re-derives the same outcome with window
functions and correlated subqueries, the way a sequential reader of the
reference's rules would write it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import changes as M
from rosterlake.sources import fixture_requests as RQ

from .adapter_sql import with_adapter
from .registry import fx, register, tables
from .requests_sql import REQUEST_CTES


def _sql(ctes: list[str], select: str) -> str:
    return with_adapter(",\n".join(c.strip() for c in ctes), select)


def _after(w: str = "w") -> str:
    return f"({w}.w_id is not null and (j.request_ts > {w}.w_ts or (j.request_ts = {w}.w_ts and j.request_id > {w}.w_id)))"


def _winner(src: str, keys: list[str], cond: str, extra: str = "") -> str:
    k = ", ".join(keys)
    return f"""
w AS (select {k}, request_ts as w_ts, request_id as w_id{extra} from (
        select *, row_number() over (partition by {k} order by request_ts, request_id) as rn
        from {src} where {cond}) q where rn = 1)"""


def _on(keys: list[str], left: str = "j", right: str = "w") -> str:
    return " and ".join(f"{left}.{k} = {right}.{k}" for k in keys)


def _ids(table: str) -> str:
    return f"coalesce((select max(id) from {table}), 0) + row_number() over (order by request_ts, request_id)"


def _triple(key: str, fn, ctes: list[str], rejected_sel: str, accepted_sel: str, state_sel: str | None = None,
            accepted_view=None):
    view = accepted_view or (lambda df: df)
    register(f"{key}_rejected", _sql(ctes, rejected_sel))(lambda s, d: fn(s, d).rejected)
    register(f"{key}_accepted", _sql(ctes, accepted_sel))(lambda s, d: view(fn(s, d).accepted))
    if state_sel is not None:
        register(f"{key}_state", _sql(ctes, state_sel[1]))(lambda s, d: fn(s, d).states[state_sel[0]])


_REJ = "select request_id, reason from fin where reason is not null"


def _grown(key: str, fn, ctes: list[str], relation: str, accepted_sel: str, existing: str | None = None):
    """``<key>_state`` of an insert: the old rows and the accepted ones."""
    register(f"{key}_state", _sql(ctes, f"""
select * from {existing or relation}
union all by name
select * exclude (request_id) from ({accepted_sel}) q"""))(lambda s, d: fn(s, d).states[relation])

# ------------------------------------------------------------------ M8


def _m08(spark, d):
    f = fx(spark, d, "session", "booking")
    return M.admit_bookings(f.booking_request, f.tables.with_(booking=f.existing_booking))


_M08 = ["""
req AS (select request_id, request_ts, actor_role, actor_id, session_id,
               coalesce(status, 'Pending') as status from booking_request)""", """
pairs AS (select session_id as e_sid, member_id as e_mid, bool_or(coalesce(status <> 'Cancel', false)) as live
          from existing_booking group by session_id, member_id)""", """
avail AS (select s.id as s_id, s.start_time as s_start from session s
          where s.status not in ('cancelled', 'completed')
            and exists (select 1 from trainer t where t.id = s.trainer_id))""", """
j0 AS (select r.*, u.nama as u_nama,
         case when r.session_id is null or r.session_id = 0 then 'session_id_required'
              when u.id is null then 'customer_not_found'
              when a.s_id is null then 'session_unavailable'
              when a.s_start < r.request_ts then 'already_started'
              when p.live then 'already_booked'
              when not p.live then 'unique_key_conflict' end as base,
         coalesce(r.status in ('Pending', 'Confirmed', 'Cancel'), false) as ok
       from req r left join users u on u.id = r.actor_id
                  left join avail a on a.s_id = r.session_id
                  left join pairs p on p.e_sid = r.session_id and p.e_mid = r.actor_id)""",
    _winner("j0", ["session_id", "actor_id"], "base is null and ok", ", status as w_status"), f"""
fin AS (select j.*, coalesce(j.base,
          case when {_after()} then case when w.w_status <> 'Cancel' then 'already_booked'
                                         else 'unique_key_conflict' end end,
          case when not j.ok then 'invalid_status' end) as reason
        from j0 j left join w on {_on(['session_id', 'actor_id'])})"""]

_A08 = f"""
select request_id, {_ids('existing_booking')} as id, session_id, actor_id as member_id, status,
       request_ts as datetime_created, u_nama as member_name
from fin where reason is null"""
_triple("m08_admit_bookings", _m08, _M08, _REJ, _A08)
_grown("m08_admit_bookings", _m08, _M08, "booking", _A08, "existing_booking")

# ------------------------------------------------------------------ M9


def _m09(spark, d):
    t = tables(spark, d, "session", "booking")
    return M.change_booking_status(RQ.status_change_requests(t), t)


_M09 = [REQUEST_CTES["status_req"], """
bs AS (select b.id as b_id, b.member_id as b_member, s.trainer_id as s_trainer
       from booking b join session s on b.session_id = s.id)""", """
fin AS (select r.*, case
          when r.status is null or r.status not in ('Pending', 'Confirmed', 'Cancel') then 'invalid_status'
          when bs.b_id is null then 'booking_not_found'
          when r.actor_role = 'customer' and (r.actor_id is distinct from bs.b_member or r.status <> 'Cancel')
            then 'unauthorized'
          when r.actor_role = 'trainer' and r.actor_id is distinct from bs.s_trainer then 'not_your_session'
        end as reason
        from status_req r left join bs on bs.b_id = r.booking_id)""", """
last AS (select booking_id, status as new_status from (
           select *, row_number() over (partition by booking_id order by request_ts desc, request_id desc) as rn
           from fin where reason is null) q where rn = 1)"""]

_triple("m09_change_booking_status", _m09, _M09, _REJ,
        "select request_id, booking_id, status from fin where reason is null",
        ("booking", """
select b.id, b.session_id, b.member_id, coalesce(l.new_status, b.status) as status, b.datetime_created,
       b.member_name
from booking b left join last l on l.booking_id = b.id"""))

# ------------------------------------------------------------------ M13


def _m13(spark, d):
    t = tables(spark, d, "booking")
    return M.admit_reviews(RQ.review_requests(t), t)


_M13 = [REQUEST_CTES["review_req"], """
j0 AS (select r.*, case
         when r.actor_role is null or r.actor_role <> 'customer' then 'not_customer'
         when r.session_id is null or r.session_id = 0 or r.rating_score is null or r.rating_score = 0
           then 'fields_required'
         when r.rating_score < 1 or r.rating_score > 5 then 'rating_out_of_range'
         when not exists (select 1 from booking b where b.status = 'Confirmed' and b.session_id = r.session_id
                          and b.member_id = r.actor_id) then 'no_confirmed_booking'
         when exists (select 1 from reviews v where v.session_id = r.session_id and v.member_id = r.actor_id)
           then 'already_reviewed' end as base
       from review_req r)""",
    _winner("j0", ["session_id", "actor_id"], "base is null"), f"""
fin AS (select j.*, coalesce(j.base, case when {_after()} then 'already_reviewed' end) as reason
        from j0 j left join w on {_on(['session_id', 'actor_id'])})"""]

_A13 = f"""
select request_id, {_ids('reviews')} as id, session_id, actor_id as member_id,
       cast(round(rating_score) as tinyint) as rating_score, nullif(comment, '') as comment,
       request_ts as datetime_created
from fin where reason is null"""
_triple("m13_admit_reviews", _m13, _M13, _REJ, _A13)
_grown("m13_admit_reviews", _m13, _M13, "reviews", _A13)

# ------------------------------------------------------------------ M10


def _m10(spark, d):
    t = tables(spark, d, "booking", "progress")
    return M.admit_progress(RQ.progress_requests(t), t)


_M10 = [REQUEST_CTES["progress_req"], r"""
fin AS (select r.*, case
          when r.actor_role is null or r.actor_role <> 'customer' then 'not_customer'
          when r.activity is null or r.activity = '' or r.duration is null or r.duration = ''
               or r.note is null or r.note = '' then 'fields_required'
          when r.booking_id is not null and r.booking_id <> 0
               and not exists (select 1 from booking b where b.status = 'Confirmed' and b.id = r.booking_id
                               and b.member_id = r.actor_id) then 'booking_not_confirmed'
          when not coalesce(regexp_full_match(r.duration, '\s*[+-]?[0-9]+\s*'), false)
               or try_cast(trim(r.duration) as integer) is null then 'invalid_duration'
        end as reason
        from progress_req r)"""]

_A10 = f"""
select request_id, {_ids('progress')} as id, actor_id as member_id,
       case when booking_id <> 0 then booking_id end as booking_id, activity,
       cast(trim(duration) as integer) as duration, note, request_ts as jam_nyatat
from fin where reason is null"""
_triple("m10_admit_progress", _m10, _M10, _REJ, _A10)
_grown("m10_admit_progress", _m10, _M10, "progress", _A10)

# ------------------------------------------------------------------ M5


def _m05(spark, d):
    t = tables(spark, d, "session")
    return M.admit_sessions(RQ.session_requests(t), t)


_M05 = [REQUEST_CTES["session_req"], """
fin AS (select r.*, coalesce(r.status, 'scheduled') as st, case
          when r.actor_role is null or r.actor_role not in ('trainer', 'admin') then 'forbidden'
          when r.title is null or r.title = '' or r.trainer_id is null or r.trainer_id = 0
               or r.start_time is null then 'fields_required'
          when not exists (select 1 from trainer t where t.id = r.trainer_id) then 'trainer_not_found'
          when coalesce(r.status, 'scheduled') not in ('scheduled', 'ongoing', 'completed', 'cancelled')
            then 'invalid_status'
        end as reason
        from session_req r)"""]

_A05 = f"""
select request_id, {_ids('session')} as id, title, deskripsi, trainer_id, start_time, end_time, price,
       st as status
from fin where reason is null"""
_triple("m05_admit_sessions", _m05, _M05, _REJ, _A05)
_grown("m05_admit_sessions", _m05, _M05, "session", _A05)

# ------------------------------------------------------------------ patches


def _patch_state(table: str, cols: list[str], fields: list[str], touch: str | None = None,
                 value: dict[str, str] | None = None) -> tuple[str, str]:
    """CTEs and final SELECT applying the accepted patches in ``acc``: per
    field, the value of the latest accepted patch that names it."""
    value = value or {}
    ctes = ["acc AS (select *, row_number() over (order by request_ts, request_id) as seq "
            "from fin where reason is null)",
            "lt AS (select id, max(request_ts) as last_ts from acc group by id)"]
    joins, exprs = [], {}
    for i, f in enumerate(fields):
        ctes.append(f"l{i} AS (select id, max(seq) as s from acc where list_contains(present, '{f}') group by id)")
        joins.append(f"left join l{i} on l{i}.id = t.id left join acc a{i} on a{i}.seq = l{i}.s")
        v = value.get(f, f"a{i}.{f}").replace("{a}", f"a{i}")
        exprs[f] = f"case when l{i}.s is not null then {v} else t.{f} end"
    sel = []
    for c in cols:
        if c in exprs:
            sel.append(f"{exprs[c]} as {c}")
        elif c == touch:
            changed = " or ".join(f"({exprs[f]}) is distinct from t.{f}" for f in fields)
            sel.append(f"case when lt.id is not null and ({changed}) then lt.last_ts else t.{c} end as {c}")
        else:
            sel.append(f"t.{c}")
    select = f"select {', '.join(sel)} from {table} t {' '.join(joins)} left join lt on lt.id = t.id"
    return ",\n".join(ctes), select


def _m06(spark, d):
    t = tables(spark, d, "session")
    return M.patch_sessions(RQ.session_patches(t), t)


_SESSION_COLS = ["id", "title", "deskripsi", "trainer_id", "start_time", "end_time", "price", "status", "updated_at"]
_M06 = [REQUEST_CTES["session_patch"], """
fin AS (select r.*, case
          when r.actor_role is null or r.actor_role not in ('trainer', 'admin') then 'forbidden'
          when list_contains(r.present, 'trainer_id')
               and not exists (select 1 from trainer t where t.id = r.trainer_id) then 'invalid_trainer'
          when list_contains(r.present, 'status') and (r.status is null or r.status not in
               ('scheduled', 'ongoing', 'completed', 'cancelled')) then 'invalid_status'
          when not list_has_any(r.present, ['title', 'deskripsi', 'trainer_id', 'start_time', 'end_time', 'price',
                                            'status']) then 'no_fields'
          when not exists (select 1 from session s where s.id = r.id) then 'not_found'
          when (list_contains(r.present, 'title') and r.title is null)
               or (list_contains(r.present, 'start_time') and r.start_time is null) then 'not_null'
        end as reason
        from session_patch r)"""]
_c06, _s06 = _patch_state("session", _SESSION_COLS, list(M.SESSION_PATCH_FIELDS), touch="updated_at")
# ``present`` is exposed as a comma-joined string (list order kept) so both
# sides compare plain values.
_PRESENT_SEL = "select request_id, id, array_to_string(present, ',') as present from fin where reason is null"


def _present_str(df):
    return df.withColumn("present", F.array_join("present", ","))


_triple("m06_patch_sessions", _m06, _M06 + [_c06], _REJ, _PRESENT_SEL, ("session", _s06), accepted_view=_present_str)


def _m11(spark, d):
    t = tables(spark, d, "progress")
    return M.patch_progress(RQ.progress_patches(t), t)


_M11 = [REQUEST_CTES["progress_patch"], r"""
fin AS (select r.*, case
          when p.id is null then 'not_found'
          when not (coalesce(r.actor_role = 'admin', false)
                    or coalesce(r.actor_role = 'customer' and r.actor_id is not distinct from p.member_id, false))
            then 'forbidden'
          when not list_has_any(r.present, ['activity', 'duration', 'note']) then 'no_fields'
          when list_contains(r.present, 'duration')
               and (not coalesce(regexp_full_match(r.duration, '\s*[+-]?[0-9]+\s*'), false)
                    or try_cast(trim(r.duration) as integer) is null) then 'invalid_duration'
          when (list_contains(r.present, 'activity') and r.activity is null)
               or (list_contains(r.present, 'note') and r.note is null) then 'not_null'
        end as reason
        from progress_patch r left join progress p on p.id = r.id)"""]
_c11, _s11 = _patch_state("progress", ["id", "member_id", "booking_id", "activity", "duration", "note", "jam_nyatat"],
                          list(M.PROGRESS_PATCH_FIELDS), value={"duration": "cast(trim({a}.duration) as integer)"})
_triple("m11_patch_progress", _m11, _M11 + [_c11], _REJ, _PRESENT_SEL, ("progress", _s11),
        accepted_view=_present_str)


def _m14(spark, d):
    t = tables(spark, d, "booking")
    return M.patch_reviews(RQ.review_patches(t), t)


_M14 = [REQUEST_CTES["review_patch"], """
fin AS (select r.*, case
          when list_contains(r.present, 'rating_score') and (r.rating_score is null or r.rating_score < 1
               or r.rating_score > 5) then 'rating_out_of_range'
          when v.id is null then 'not_found'
          when not (coalesce(r.actor_role = 'admin', false)
                    or coalesce(r.actor_role = 'customer' and r.actor_id is not distinct from v.member_id, false))
            then 'forbidden'
          when not list_has_any(r.present, ['rating_score', 'comment']) then 'no_fields'
        end as reason
        from review_patch r left join reviews v on v.id = r.id)"""]
_c14, _s14 = _patch_state("reviews", ["id", "session_id", "member_id", "rating_score", "comment", "datetime_created"],
                          list(M.REVIEW_PATCH_FIELDS),
                          value={"rating_score": "cast(round({a}.rating_score) as tinyint)"})
_triple("m14_patch_reviews", _m14, _M14 + [_c14], _REJ, _PRESENT_SEL, ("reviews", _s14),
        accepted_view=_present_str)

# ------------------------------------------------------------------ deletes


def _delete_sql(req: str, target_cte: str, early: str | None, checks: list[tuple[str, str]]) -> list[str]:
    """``early``: condition checked before existence (route guard)."""
    parts = [f"when {early} then 'forbidden'"] if early else []
    parts.append("when tg.t_id is null then 'not_found'")
    parts += [f"when {cond} then '{reason}'" for reason, cond in checks]
    early_hit = "j.base = 'forbidden'" if early else "false"
    return [REQUEST_CTES[req], target_cte, f"""
j0 AS (select r.*, tg.*, case {' '.join(parts)} end as base from {req} r left join tg on tg.t_id = r.id)""",
            _winner("j0", ["id"], "base is null"), f"""
fin AS (select j.request_id, j.request_ts, j.id,
               case when {early_hit} then j.base when {_after()} then 'not_found' else j.base end as reason
        from j0 j left join w on {_on(['id'])})"""]


_ADMIN = "coalesce(r.actor_role = 'admin', false)"


def _owner(role: str, col: str) -> str:
    return f"coalesce(r.actor_role = '{role}' and r.actor_id is not distinct from tg.{col}, false)"


_STAFF_GUARD = "not coalesce(r.actor_role in ('trainer', 'admin'), false)"
_ACC = "select request_id, request_ts, id from fin where reason is null"


def _m12(spark, d):
    t = tables(spark, d, "progress")
    return M.delete_progress(RQ.progress_deletes(t), t)


_M12 = _delete_sql("progress_del", "tg AS (select id as t_id, member_id from progress)", None,
                   [("forbidden", f"not ({_ADMIN} or {_owner('customer', 'member_id')})")])
_triple("m12_delete_progress", _m12, _M12, _REJ, _ACC,
        ("progress", "select * from progress where id not in (select id from fin where reason is null)"))


def _m15(spark, d):
    t = tables(spark, d, "booking")
    return M.delete_reviews(RQ.review_deletes(t), t)


_M15 = _delete_sql("review_del", "tg AS (select id as t_id, member_id from reviews)", None,
                   [("forbidden", f"not ({_ADMIN} or {_owner('customer', 'member_id')})")])
_triple("m15_delete_reviews", _m15, _M15, _REJ, _ACC,
        ("reviews", "select * from reviews where id not in (select id from fin where reason is null)"))


def _m07(spark, d):
    t = tables(spark, d, "session", "booking", "progress")
    return M.delete_sessions(RQ.session_deletes(t), t)


_M07 = _delete_sql("session_del", """
tg AS (select s.id as t_id, s.trainer_id,
              s.id in (select session_id from reviews)
              or s.id in (select b.session_id from progress p join booking b on p.booking_id = b.id) as referenced
       from session s)""", _STAFF_GUARD,
                   [("not_owner", f"not ({_ADMIN} or {_owner('trainer', 'trainer_id')})"),
                    ("referenced", "tg.referenced")])
_triple("m07_delete_sessions", _m07, _M07, _REJ, _ACC,
        ("booking", "select * from booking where session_id not in (select id from fin where reason is null)"))
register("m07_delete_sessions_session_state", _sql(_M07, "select * from session where id not in (select id from fin where reason is null)"))(
    lambda s, d: _m07(s, d).states["session"])


def _m18(mode: str):
    def run(spark, d):
        t = tables(spark, d, "booking", "progress")
        return M.delete_users(RQ.user_deletes(t), t, mode=mode)
    return run


_REFS = {
    "restrict": "select member_id from booking union all select member_id from progress "
                "union all select member_id from reviews",
    "cascade": "select b.member_id from progress p join booking b on p.booking_id = b.id "
               "where b.member_id <> p.member_id",
}
for _mode in ("restrict", "cascade"):
    _M18 = _delete_sql("user_del", f"""
tg AS (select u.id as t_id, u.id in ({_REFS[_mode]}) as referenced from users u)""",
                       f"not {_ADMIN}", [("referenced", "tg.referenced")])
    _triple(f"m18_delete_users_{_mode}", _m18(_mode), _M18, _REJ, _ACC,
            ("booking" if _mode == "cascade" else "users",
             "select * from booking where member_id not in (select id from fin where reason is null)"
             if _mode == "cascade" else "select * from users where id not in (select id from fin where reason is null)"))

    if _mode == "cascade":
        for _rel, _key in (("users", "id"), ("progress", "member_id"), ("reviews", "member_id")):
            register(f"m18_delete_users_cascade_{_rel}_state",
                     _sql(_M18, f"select * from {_rel} where {_key} not in (select id from fin where reason is null)"))(
                lambda s, d, rel=_rel, run=_m18(_mode): run(s, d).states[rel])

# ------------------------------------------------------------------ merges


def _merge_sql(req: str, table: str, cols: list[str], fields: list[str], allowed: str, unique: bool,
               ek: str = "lower(rtrim({}))") -> list[str]:
    """With ``unique``, the claims are replayed one by one: a recursion carries
    who holds which mail. (It needs WITH RECURSIVE, see ``_recursive``.)"""
    ctes = [REQUEST_CTES[req], f"""
fin0 AS (select r.*, case when not ({allowed}) then 'forbidden'
                          when not exists (select 1 from {table} x where x.id = r.id) then 'not_found' end as base
         from {req} r)"""]
    if unique:
        ctes += [f"""
claims AS (select request_id, id as row_id, {ek.format('email')} as ek, row_number() over (order by request_ts, request_id) as seq
           from fin0 where base is null and email is not null and email <> '')""", f"""
sim AS (select cast(0 as bigint) as seq, map_from_entries(list((ek, id))) as held, map_from_entries(list((id, ek))) as spot, true as granted
        from (select {ek.format('email')} as ek, id from {table}) q
        union all
        select seq, case when ok then map_concat(map_concat(held, map {{spot[row_id]: cast(null as bigint)}}), map {{ek: row_id}}) else held end,
               case when ok then map_concat(spot, map {{row_id: ek}}) else spot end, ok
        from (select c.seq, c.row_id, c.ek, sim.held, sim.spot, coalesce(sim.held[c.ek], c.row_id) = c.row_id as ok
              from sim join claims c on c.seq = sim.seq + 1) q)""", """
fin AS (select f.*, coalesce(f.base, case when not s.granted then 'duplicate_email' end) as reason
        from fin0 f left join claims c on c.request_id = f.request_id left join sim s on s.seq = c.seq)"""]
    else:
        ctes.append("fin AS (select *, base as reason from fin0)")
    ctes.append("acc AS (select *, row_number() over (order by request_ts, request_id) as seq from fin where reason is null)")
    joins, sel = [], []
    for i, f in enumerate(fields):
        ctes.append(f"l{i} AS (select id, max(seq) as s from acc where {f} is not null and {f} <> '' group by id)")
        joins.append(f"left join l{i} on l{i}.id = t.id left join acc a{i} on a{i}.seq = l{i}.s")
    for c in cols:
        sel.append(f"coalesce(nullif(a{fields.index(c)}.{c}, ''), t.{c}) as {c}" if c in fields else f"t.{c}")
    ctes.append(f"merged AS (select {', '.join(sel)} from {table} t {' '.join(joins)})")
    return ctes


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _merge_queries(key: str, fn, ctes: list[str], cols: list[str], state: str, head=lambda ctes, select: _recursive(_sql(ctes, select))):
    register(f"{key}_rejected", head(ctes, _REJ))(lambda s, d: fn(s, d).rejected)
    register(f"{key}_accepted", head(ctes, "select request_id, id from fin where reason is null"))(lambda s, d: fn(s, d).accepted)
    register(f"{key}_state", head(ctes, f"select {', '.join(cols)} from merged"))(lambda s, d: fn(s, d).states[state])


def _m16(spark, d):
    t = tables(spark, d)
    return M.merge_user_profiles(RQ.user_merges(t), t)


def _m17(spark, d):
    t = tables(spark, d)
    return M.merge_trainer_profiles(RQ.trainer_merges(t), t)


_USER_COLS = ["id", "nama", "email", "propinsi", "kota", "created_at"]
_USER_FIELDS = ["nama", "email", "propinsi", "kota"]
_SELF_OR_ADMIN = ("coalesce(r.actor_role = 'admin', false) or "
                  "coalesce(r.actor_role = 'customer' and r.actor_id is not distinct from r.id, false)")
_merge_queries("m16_merge_user_profiles", _m16, _merge_sql("user_merge", "users", _USER_COLS, _USER_FIELDS, _SELF_OR_ADMIN, True), _USER_COLS, "users")


def _m16_swaps(spark, d):
    t = tables(spark, d)
    return M.merge_user_profiles(RQ.user_swaps(t), t)


_merge_queries("m16_merge_user_profiles_swaps", _m16_swaps,
               _merge_sql("user_swap", "users", _USER_COLS, _USER_FIELDS, _SELF_OR_ADMIN, True), _USER_COLS, "users")
_TRAINER_COLS = ["id", "nama", "email", "spesialisasi", "propinsi", "kota"]
_merge_queries("m17_merge_trainer_profiles", _m17, _merge_sql(
    "trainer_merge", "trainer", _TRAINER_COLS, _TRAINER_COLS[1:], _SELF_OR_ADMIN.replace("'customer'", "'trainer'"), False), _TRAINER_COLS, "trainer")

# ------------------------------------------------------------------ registrations


def _reg_sql(req: str, table: str, guard: str | None) -> list[str]:
    first = f"when {guard} then 'forbidden' " if guard else ""
    return [REQUEST_CTES[req], f"""
j0 AS (select r.*, lower(rtrim(r.email)) as ek, case {first}
         when r.nama is null or r.nama = '' or r.email is null or r.email = ''
              or not coalesce(r.has_password, false) then 'fields_required'
         when exists (select 1 from {table} x where lower(rtrim(x.email)) = lower(rtrim(r.email)))
           then 'duplicate_email' end as base
       from {req} r)""", _winner("j0", ["ek"], "base is null"), f"""
fin AS (select j.*, coalesce(j.base, case when {_after()} then 'duplicate_email' end) as reason
        from j0 j left join w on {_on(['ek'])})"""]


def _m02(spark, d):
    t = tables(spark, d)
    return M.register_customers(RQ.customer_registrations(t), t)


def _m03(spark, d):
    t = tables(spark, d)
    return M.register_trainers(RQ.trainer_registrations(t), t)


def _m04(spark, d):
    t = tables(spark, d)
    return M.register_admins(RQ.admin_registrations(t), t)


_PLACE = "coalesce(nullif(propinsi, ''), '') as propinsi, coalesce(nullif(kota, ''), '') as kota"
_A02 = f"""
select request_id, {_ids('users')} as id, nama, email, {_PLACE}, request_ts as created_at
from fin where reason is null"""
_triple("m02_register_customers", _m02, _reg_sql("cust_reg", "users", None), _REJ, _A02)
_grown("m02_register_customers", _m02, _reg_sql("cust_reg", "users", None), "users", _A02)
_A03 = f"""
select request_id, {_ids('trainer')} as id, nama, email,
       coalesce(nullif(spesialisasi, ''), '') as spesialisasi, {_PLACE}
from fin where reason is null"""
_triple("m03_register_trainers", _m03, _reg_sql("trainer_reg", "trainer", None), _REJ, _A03)
_grown("m03_register_trainers", _m03, _reg_sql("trainer_reg", "trainer", None), "trainer", _A03)
_A04 = f"select request_id, {_ids('admin')} as id, nama, email from fin where reason is null"
_triple("m04_register_admins", _m04, _reg_sql("admin_reg", "admin", "not coalesce(r.actor_role = 'admin', false)"), _REJ, _A04)
_grown("m04_register_admins", _m04, _reg_sql("admin_reg", "admin", "not coalesce(r.actor_role = 'admin', false)"), "admin", _A04)

# ------------------------------------------------------------------ Q10 on changed state

import re  # noqa: E402

from rosterlake.operators import audit as Q  # noqa: E402


def _q10_after(spark, d):
    """Q10 after admission (M8 copies the member's name into the booking) and
    profile merges (M16 renames members): stored names that went stale."""
    f = fx(spark, d, "session", "booking")
    t = f.tables
    admitted = M.admit_bookings(f.booking_request, t.with_(booking=f.existing_booking)).states["booking"]
    merged = M.merge_user_profiles(RQ.user_merges(t), t).states["users"]
    return Q.member_name_drift(t.with_(booking=admitted, users=merged))


_M16_CTES = [re.sub(r"\bfin\b", "mfin", c) for c in _merge_sql("user_merge", "users", _USER_COLS, _USER_FIELDS, _SELF_OR_ADMIN, True)]
register("q10_member_name_drift_after_changes", _recursive(_sql(_M08 + _M16_CTES + [f"""
acc8 AS (select {_ids('existing_booking')} as id, session_id, actor_id as member_id, u_nama as member_name
         from fin where reason is null)""", """
bstate AS (select id, member_id, member_name from existing_booking
           union all select id, member_id, member_name from acc8)"""], """
select 'member_name_drift' as rule, 'booking' as relation, cast(b.id as varchar) as "key",
       'stored=' || b.member_name || ',current=' || u.nama as detail
from bstate b join merged u on b.member_id = u.id
where b.member_name is not null and b.member_name != u.nama""")))(_q10_after)
