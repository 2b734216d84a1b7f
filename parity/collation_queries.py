"""Registered queries on accented names and mails, and their oracle SQL.

The oracle folds in its own way: the letters that the collation treats apart
are replaced first, then DuckDB strips what accents remain.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import audit as Q
from rosterlake.operators import changes as M
from rosterlake.operators import lookup as LK
from rosterlake.operators import search as P
from rosterlake.sources import fixture_requests as RQ

from .adapter_sql import with_adapter
from .change_queries import _reg_sql
from .registry import register, tables


def fold(x: str) -> str:
    apart = f"translate({x}, 'ÅåÄäÆæÖöÜüÝýÐð', '[[\\\\\\\\]]yyyydd')"
    return f"lower(rtrim(strip_accents({apart})))"


def _mail(k: str) -> str:
    return f"'customer' || lpad(cast({k} as varchar), 9, '0') || '@example.test'"


_ACCENTED = f"""
ausers AS (
  select id, case id % 5 when 0 then replace(replace(nama, 'e', 'é'), 'o', 'ö') when 1 then replace(replace(nama, 'u', 'ü'), 'C', 'Ç')
                         when 2 then replace(nama, 'e', 'Ê') else upper(nama) end as nama,
         case id % 6 when 0 then {_mail('id')} when 1 then replace({_mail('id - 1')}, 'e', 'É') when 2 then replace({_mail('id - 2')}, 'o', 'ö')
                     when 3 then replace({_mail('id - 3')}, 'o', 'Ö') || '  ' when 4 then replace({_mail('id')}, 'u', 'Ü')
                     else replace({_mail('id - 1')}, 'u', 'y') end as email,
         propinsi, kota, created_at from users),
atrainer AS (
  select id, case when id % 2 = 0 then replace(replace(nama, 'u', 'Ù'), 'e', 'Ê') else replace(nama, 'S', 's') end as nama,
         case when id % 3 = 0 then replace(replace(upper({_mail('id')}), 'E', 'è'), 'A', 'Â') else email end as email,
         spesialisasi, propinsi, kota from trainer)"""


def accented_sql(ctes: str, select: str) -> str:
    return with_adapter(_ACCENTED + (",\n" + ctes.strip() if ctes else ""), select)


def accented(spark, d):
    return RQ.accented(tables(spark, d))


_EMAIL_KEYS = f"""
k AS (select distinct {fold('x')} as lookup_key
      from (select replace(replace(email, 'a', 'À'), 'e', 'ê') as x from ausers where id % 2 = 0 union all select email from atrainer
            union all select email from admin) q),
hit AS (select k.lookup_key, u.id, u.nama, u.email, row_number() over (partition by k.lookup_key order by u.id) as rn
        from k join ausers u on {fold('u.email')} = k.lookup_key)"""


def _email_keys(t):
    return (t.users.where("id % 2 = 0").select(F.translate("email", "ae", "Àê").alias("x")).unionByName(t.trainer.select(F.col("email").alias("x")))
            .unionByName(t.admin.select(F.col("email").alias("x"))))


@register("s07_user_by_email_accented_found", accented_sql(_EMAIL_KEYS, "select lookup_key, id, nama, email from hit where rn = 1"))
def s07_email_found(spark, d):
    t = accented(spark, d)
    return LK.user_by_email(t, _email_keys(t)).found


@register("s07_user_by_email_accented_missing", accented_sql(_EMAIL_KEYS, "select lookup_key from k where lookup_key not in (select lookup_key from hit)"))
def s07_email_missing(spark, d):
    t = accented(spark, d)
    return LK.user_by_email(t, _email_keys(t)).missing


@register("s07_trainer_by_name_accented_found", accented_sql(f"""
k AS (select distinct {fold('x')} as lookup_key from (select replace(nama, 'i', 'Ì') as x from trainer) q),
hit AS (select k.lookup_key, t.*, row_number() over (partition by k.lookup_key order by t.id) as rn
        from k join atrainer t on {fold('t.nama')} = k.lookup_key)""", """
select lookup_key, id, nama, email, spesialisasi, propinsi, kota from hit where rn = 1"""))
def s07_name_found(spark, d):
    t = tables(spark, d)
    return LK.trainer_by_name(RQ.accented(t), t.trainer.select(F.translate("nama", "i", "Ì").alias("x"))).found


@register("s09_account_directory_accented", accented_sql(f"""
acc AS (select {fold('email')} as email_key, 0 as rnk, id, 'customer' as role, nama, email from ausers
        union all select {fold('email')}, 1, id, 'trainer', nama, email from atrainer
        union all select {fold('email')}, 2, id, 'admin', nama, email from admin),
ranked AS (select *, row_number() over (partition by email_key order by rnk, id) as rn from acc)""", """
select email_key, role, id, nama, email from ranked where rn = 1"""))
def s09(spark, d):
    return LK.account_directory(accented(spark, d))


@register("q02_unique_keys_accented", accented_sql("", f"""
select 'unique_key' as rule, 'users' as relation, {fold('email')} as "key", 'count=' || cast(count(*) as varchar) as detail
from ausers group by 3 having count(*) > 1"""))
def q02(spark, d):
    return Q.unique_keys(accented(spark, d)).where("relation = 'users'")


# The searches' terms have accents too; the patterns below are folded by hand:
# é is an e, ö is not an o.
_P1 = dict(nama="CÙSTOMÉR_0%", email="ëxample", sort="nama", order="DESC", page=2, limit=15)
_P1_WHERE = f"where {fold('nama')} like '%customer_0%' and {fold('email')} like '%example%'"


@register("p01_search_users_accented", accented_sql("", f"""
select id, nama, email, propinsi, kota, created_at from ausers {_P1_WHERE} order by {fold('nama')} desc nulls last, id limit 15 offset 15"""))
def p01(spark, d):
    return P.search_users(accented(spark, d).users, **_P1).rows


@register("p01_search_users_swedish_letters", accented_sql("", f"""
select id, nama, email, propinsi, kota, created_at from ausers where {fold('nama')} like '%cust]m%' order by id limit 20"""))
def p01_swedish(spark, d):
    return P.search_users(accented(spark, d).users, nama="CustÖm").rows


@register("p02_search_trainers_accented", accented_sql("", f"""
select id, nama, email, spesialisasi as specialization, propinsi, kota from atrainer
where {fold('nama')} like '%supplier#%0%' order by id limit 7 offset 7"""))
def p02(spark, d):
    return P.search_trainers(accented(spark, d).trainer, nama="sÚpplìer#%0", page=2, limit=7).rows


@register("p03_search_total_users_accented", accented_sql("", f"select count(*) as total from ausers {_P1_WHERE}"))
def p03(spark, d):
    return P.search_users(accented(spark, d).users, **_P1).total


def _m02(spark, d):
    t = accented(spark, d)
    return M.register_customers(RQ.accented_registrations(t), t)


_M02_CTES = [c.replace("lower(rtrim(r.email))", fold("r.email")).replace("lower(rtrim(x.email))", fold("x.email"))
             for c in _reg_sql("cust_reg", "ausers", None)]
_M02_CTES[0] = _M02_CTES[0].replace("cust_reg AS", "plain_reg AS").replace("from users", "from ausers") + """,
cust_reg AS (select * replace (case when request_id % 4 = 2 then replace(replace(email, 'E', 'Ë'), 'A', 'À') else replace(email, 't', 'T') end as email)
             from plain_reg)"""


def _m02_sql(select: str) -> str:
    return accented_sql(",\n".join(c.strip() for c in _M02_CTES), select)


@register("m02_register_customers_accented_rejected", _m02_sql("select request_id, reason from fin where reason is not null"))
def m02_rejected(spark, d):
    return _m02(spark, d).rejected


@register("m02_register_customers_accented_accepted", _m02_sql("""
select request_id, coalesce((select max(id) from ausers), 0) + row_number() over (order by request_ts, request_id) as id, nama, email,
       coalesce(nullif(propinsi, ''), '') as propinsi, coalesce(nullif(kota, ''), '') as kota, request_ts as created_at
from fin where reason is null"""))
def m02_accepted(spark, d):
    return _m02(spark, d).accepted
