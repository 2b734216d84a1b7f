"""The driver-table adapter as DuckDB CTEs (FIXTURES.md section 2), used as
the prefix of every oracle query. Written independently of the Spark adapter
in ``rosterlake.sources.adapter``; the parity tests compare the two."""

AS_OF_SQL = "timestamp '1997-01-01 00:00:00'"

ADAPTER_CTES = f"""
users AS (
  select c_custkey as id, c_name as nama,
         lower(replace(c_name, '#', '')) || '@example.test' as email,
         r_name as propinsi, n_name as kota, cast(null as timestamp) as created_at
  from customer join nation on c_nationkey = n_nationkey
                join region on n_regionkey = r_regionkey),
trainer AS (
  select s_suppkey as id, s_name as nama,
         lower(replace(s_name, '#', '')) || '@example.test' as email,
         case s_suppkey % 3 when 0 then 'strength' when 1 then 'yoga' else '' end as spesialisasi,
         r_name as propinsi, n_name as kota
  from supplier join nation on s_nationkey = n_nationkey
                join region on n_regionkey = r_regionkey),
admin AS (
  select cast(r_regionkey as bigint) as id, r_name as nama,
         lower(r_name) || '@admin.example.test' as email
  from region),
line AS (
  select l_orderkey, l_partkey, l_suppkey, l_shipdate,
         l_suppkey * 1000 + (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as sid
  from lineitem),
session AS (
  select g.id, p_name as title, p_type as deskripsi, g.trainer_id, g.start_time,
         case when g.trainer_id % 10 = 0 then null
              else g.start_time + interval '1' hour end as end_time,
         cast(p_retailprice as decimal(10,2)) as price,
         case p_size % 8 when 0 then 'cancelled' when 1 then 'completed'
                         when 2 then 'ongoing' else 'scheduled' end as status,
         cast(null as timestamp) as updated_at
  from (select sid as id, l_suppkey as trainer_id,
               min(l_shipdate) as start_time, min(l_partkey) as pk
        from line group by sid, l_suppkey) g
  join part on p_partkey = g.pk),
booking_full AS (
  select o_orderkey as id, x.sid as session_id, o_custkey as member_id,
         case o_orderstatus when 'P' then 'Pending' when 'F' then 'Confirmed'
                            else 'Cancel' end as status,
         o_orderdate as datetime_created, o_orderpriority as priority
  from orders
  join (select l_orderkey, sid,
               row_number() over (partition by l_orderkey
                                  order by l_shipdate, l_suppkey) as rn
        from line) x on l_orderkey = o_orderkey and x.rn = 1),
booking AS (
  select id, session_id, member_id, status, datetime_created, cast(null as varchar) as member_name
  from booking_full),
reviews AS (
  select id, session_id, member_id,
         cast(substr(priority, 1, 1) as tinyint) as rating_score,
         case when id % 5 = 0 then null else substr(priority, 3) end as comment,
         datetime_created
  from booking_full where status = 'Confirmed' and id % 2 = 0),
progress AS (
  select event_id as id, user_id as member_id,
         case when event_id % 3 = 0 then b.first_booking end as booking_id,
         event_type as activity, cast(floor(value) as int) as duration,
         props as note, ts as jam_nyatat
  from events
  left join (select member_id as m, min(id) as first_booking
             from booking_full group by member_id) b on b.m = user_id),
existing_booking AS (
  select * from booking where datetime_created < {AS_OF_SQL}),
booking_request AS (
  select id as request_id, datetime_created as request_ts, 'customer' as actor_role,
         case when id % 50 = 0 then cast(-1 as bigint) else member_id end as actor_id,
         case when id % 41 = 0 then null else session_id end as session_id,
         status
  from booking where datetime_created >= {AS_OF_SQL}
  union all
  select id + 1000000000, datetime_created, 'customer', member_id, session_id, 'Pending'
  from booking where datetime_created >= {AS_OF_SQL} and id % 37 = 0
  union all
  select id + 2000000000, {AS_OF_SQL}, 'customer', member_id, session_id, 'Pending'
  from existing_booking where id % 7 = 0)
"""


def with_adapter(extra_ctes: str, select: str) -> str:
    """``WITH <adapter>, <extra_ctes> <select>``; ``extra_ctes`` may be empty."""
    extra = f",\n{extra_ctes.strip().rstrip(',')}" if extra_ctes.strip() else ""
    return f"WITH {ADAPTER_CTES.strip()}{extra}\n{select.strip()}"
