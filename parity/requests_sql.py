"""Change-request frames as DuckDB CTEs (same rules as
``rosterlake.sources.fixture_requests``, written independently)."""

from .adapter_sql import AS_OF_SQL

_E = "cast([] as varchar[])"


def _actor(h: str, owner: str) -> str:
    return (f"case {h} % 5 when 0 then 'admin' when 1 then 'trainer' else 'customer' end as actor_role, "
            f"case when {h} % 7 = 0 then {owner} + 1 else {owner} end as actor_id")


def _missing(m: int) -> str:
    return f"case when id % {m} = 0 then -id - 1 else id end as id"


REQUEST_CTES = {
    "status_req": """
status_req AS (
  select id as request_id, datetime_created + interval 2 day as request_ts,
         case id % 8 when 1 then 'trainer' when 5 then 'trainer' when 2 then 'admin' when 6 then 'admin'
                     else 'customer' end as actor_role,
         case id % 8 when 3 then member_id + 1 when 1 then session_id // 1000 when 5 then session_id // 1000 + 1
                     when 2 then cast(0 as bigint) when 6 then cast(1 as bigint) else member_id end as actor_id,
         case when id % 13 = 0 then -id else id end as booking_id,
         case id % 5 when 0 then 'Cancel' when 1 then 'Confirmed' when 2 then 'Pending' when 3 then 'cancel'
                     else 'Cancel' end as status
  from booking
  union all
  select id + 1000000000, datetime_created + interval 3 day, 'admin', cast(0 as bigint), id, 'Confirmed'
  from booking where id % 3 = 0)""",
    "review_req": """
review_req AS (
  select id as request_id, datetime_created + interval 1 day as request_ts,
         case when id % 9 = 0 then 'trainer' else 'customer' end as actor_role, member_id as actor_id,
         case when id % 17 = 0 then cast(0 as bigint) else session_id end as session_id,
         cast(case id % 8 when 0 then 0.0 when 1 then 0.5 when 2 then 1.0 when 3 then 4.5 when 4 then 5.0
                          when 5 then 5.5 when 6 then 3.0 else 4.0 end as double) as rating_score,
         case when id % 4 = 0 then '' else 'comment ' || cast(id as varchar) end as comment
  from booking
  union all
  select id + 1000000000, datetime_created + interval 1 day + interval 1 hour, 'customer', member_id,
         session_id, cast(4.0 as double), 'again'
  from booking where id % 10 = 1)""",
    "progress_req": """
progress_req AS (
  select id as request_id, jam_nyatat as request_ts,
         case when id % 11 = 0 then 'admin' else 'customer' end as actor_role, member_id as actor_id,
         case id % 3 when 0 then booking_id when 1 then cast(0 as bigint) else cast(null as bigint) end as booking_id,
         case when id % 13 = 0 then '' else activity end as activity,
         case id % 7 when 0 then cast(duration as varchar) || ' mins' when 1 then ''
                     else cast(duration as varchar) end as duration,
         note
  from progress)""",
    "session_req": """
session_req AS (
  select id as request_id, start_time - interval 30 day as request_ts,
         case id % 6 when 0 then 'customer' when 1 then 'admin' else 'trainer' end as actor_role,
         trainer_id as actor_id,
         case when id % 7 = 0 then '' else title end as title, deskripsi,
         case when id % 5 = 0 then trainer_id + 100000 else trainer_id end as trainer_id,
         start_time + interval 365 day as start_time, end_time + interval 365 day as end_time, price,
         case id % 4 when 0 then cast(null as varchar) when 1 then 'Scheduled' else status end as status
  from session)""",
    "session_patch": f"""
session_patch AS (
  select id as request_id, start_time - interval 1 day as request_ts,
         case when id % 9 = 0 then 'customer' else 'trainer' end as actor_role, trainer_id as actor_id,
         case when id % 23 = 0 then -id else id end as id,
         case id % 6 when 0 then ['title'] when 1 then ['status'] when 2 then ['status']
                     when 3 then ['trainer_id', 'price'] when 4 then {_E} else ['end_time', 'deskripsi'] end as present,
         upper(title) as title, cast(null as varchar) as deskripsi, trainer_id + 1 as trainer_id,
         cast(null as timestamp) as start_time, start_time + interval 2 hour as end_time,
         cast(null as decimal(10,2)) as price,
         case id % 6 when 1 then 'cancelled' when 2 then 'Cancelled' else cast(null as varchar) end as status
  from session
  union all
  select id + 1000000000, start_time - interval 1 day + interval 1 hour, 'admin', cast(0 as bigint), id,
         ['title', 'price'], lower(title), cast(null as varchar), cast(null as bigint), cast(null as timestamp),
         cast(null as timestamp), cast(9.99 as decimal(10,2)), cast(null as varchar)
  from session where id % 4 = 0)""",
    "progress_patch": f"""
progress_patch AS (
  select id as request_id, jam_nyatat + interval 1 day as request_ts, {_actor('id', 'member_id')}, {_missing(19)},
         case id % 4 when 0 then ['activity'] when 1 then ['duration', 'note'] when 2 then {_E}
                     else ['note'] end as present,
         upper(activity) as activity, case when id % 3 = 0 then '45 mins' else '45' end as duration,
         case when id % 8 = 3 then cast(null as varchar) else 'patched' end as note
  from progress)""",
    "review_patch": f"""
review_patch AS (
  select id as request_id, datetime_created + interval 5 day as request_ts,
         {_actor('(id // 2)', 'member_id')}, {_missing(19)},
         case (id // 2) % 4 when 0 then ['rating_score'] when 1 then ['comment']
                           when 2 then ['rating_score', 'comment'] else {_E} end as present,
         cast(case (id // 2) % 6 when 0 then null when 1 then 0.5 when 2 then 4.5 else 3.0 end as double)
           as rating_score,
         case when (id // 2) % 3 = 0 then cast(null as varchar) else 'edited' end as comment
  from reviews)""",
    "progress_del": f"""
progress_del AS (
  select id as request_id, jam_nyatat + interval 2 day as request_ts, {_actor('id', 'member_id')}, {_missing(19)}
  from progress
  union all
  select id + 1000000000, jam_nyatat + interval 2 day + interval 1 hour, 'admin', cast(0 as bigint), id
  from progress where id % 6 = 0)""",
    "review_del": f"""
review_del AS (
  select id as request_id, datetime_created + interval 6 day as request_ts, {_actor('(id // 2)', 'member_id')},
         {_missing(19)}
  from reviews
  union all
  select id + 1000000000, datetime_created + interval 6 day + interval 1 hour, 'admin', cast(0 as bigint), id
  from reviews where id % 6 = 0)""",
    "session_del": f"""
session_del AS (
  select id as request_id, start_time as request_ts,
         case id % 5 when 0 then 'admin' when 1 then 'customer' else 'trainer' end as actor_role,
         case when id % 3 = 0 then trainer_id + 1 else trainer_id end as actor_id, {_missing(19)}
  from session
  union all
  select id + 1000000000, start_time + interval 1 hour, 'admin', cast(0 as bigint), id
  from session where id % 4 = 0)""",
    "user_del": f"""
user_del AS (
  select id as request_id, {AS_OF_SQL} as request_ts,
         case when id % 3 = 1 then 'customer' else 'admin' end as actor_role, cast(0 as bigint) as actor_id,
         {_missing(19)}
  from users
  union all
  select id + 1000000000, {AS_OF_SQL} + interval 1 hour, 'admin', cast(0 as bigint), id
  from users where id % 5 = 0)""",
    "user_merge": f"""
user_merge AS (
  select id as request_id, {AS_OF_SQL} as request_ts,
         case id % 4 when 0 then 'admin' when 1 then 'trainer' else 'customer' end as actor_role,
         case when id % 6 = 5 then id + 1 else id end as actor_id, {_missing(29)},
         case when id % 3 = 0 then '' else upper(nama) end as nama,
         case id % 10 when 2 then 'dup@example.test' when 6 then '' else email end as email,
         cast(null as varchar) as propinsi,
         case when id % 2 = 0 then 'KOTA_' || cast(id as varchar) else '' end as kota
  from users
  union all
  select id + 1000000000, {AS_OF_SQL} + interval 1 hour, 'admin', cast(0 as bigint), id,
         'Second ' || cast(id as varchar), cast(null as varchar), 'P2', cast(null as varchar)
  from users where id % 8 = 0)""",
    "user_swap": f"""
user_swap AS (
  select id as request_id, {AS_OF_SQL} + (7 - id % 8) * interval 1 minute as request_ts,
         case when id % 31 = 5 then 'trainer' else 'customer' end as actor_role, id as actor_id, id, 'Swapped' as nama,
         case when id % 8 < 7 then 'customer' || lpad(cast(id + 1 as varchar), 9, '0') || '@example.test'
              when (id // 8) % 3 = 0 then 'customer' || lpad(cast(id - 7 as varchar), 9, '0') || '@example.test'
              else 'moved' || cast(id as varchar) || '@example.test' end as email,
         cast(null as varchar) as propinsi, cast(null as varchar) as kota
  from users
  union all
  select id + 1000000000, {AS_OF_SQL} + (60 + id % 8) * interval 1 minute, case when id % 31 = 5 then 'trainer' else 'customer' end, id, id,
         cast(null as varchar), upper('customer' || lpad(cast(id + 2 as varchar), 9, '0') || '@example.test'), null, null
  from users where id % 4 = 1)""",
    "trainer_merge": f"""
trainer_merge AS (
  select id as request_id, {AS_OF_SQL} as request_ts,
         case id % 4 when 0 then 'admin' when 1 then 'customer' else 'trainer' end as actor_role,
         case when id % 6 = 5 then id + 1 else id end as actor_id, {_missing(29)},
         case when id % 3 = 0 then '' else lower(nama) end as nama,
         case when id % 5 = 0 then 'shared@example.test' else '' end as email,
         case when id % 2 = 0 then 'pilates' else cast(null as varchar) end as spesialisasi,
         '' as propinsi, cast(null as varchar) as kota
  from trainer)""",
}


def _reg(name: str, src: str, extra: str = "", role: bool = False, drop_place: bool = False) -> str:
    role_cols = ("case when id % 3 = 0 then 'customer' else 'admin' end as actor_role, "
                 "cast(0 as bigint) as actor_id, ") if role else ""
    place = "" if drop_place else (", case when id % 2 = 0 then cast(null as varchar) else propinsi end as propinsi, "
                                   "kota")
    return f"""
{name} AS (
  select id as request_id, {AS_OF_SQL} as request_ts, {role_cols}nama,
         case id % 4 when 0 then email when 1 then 'new' || cast(id as varchar) || '@example.test'
                     when 2 then upper('new' || cast(id - 1 as varchar) || '@example.test') else '' end as email,
         id % 5 != 0 as has_password{place}{extra}
  from {src})"""


REQUEST_CTES["cust_reg"] = _reg("cust_reg", "users")
REQUEST_CTES["trainer_reg"] = _reg("trainer_reg", "trainer",
                                   ", case when id % 2 = 0 then spesialisasi else cast(null as varchar) end as spesialisasi")
REQUEST_CTES["admin_reg"] = _reg("admin_reg", "trainer", role=True, drop_place=True)
