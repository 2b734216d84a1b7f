"""Change operators on relations in which ids repeat (``*_broken``).

A request stays one request: of the rows of its id the least counts. Requests
come from the clean relations, the state is the repeated one.
"""

from __future__ import annotations

import re

from rosterlake.operators import changes as M
from rosterlake.sources import fixture_requests as RQ

from . import change_queries as CQ
from .registry import register, tables

_AGAIN = "case when id % 4 = 1 then -1 else 1 end"
_REPEATED = ["r_users AS (select * from users union all select * from users where id % 5 = 3)"] + [
    f"r_{rel} AS (select * from {rel} union all by name select * replace ({col} + {_AGAIN} as {col}) from {rel} where id % 5 = 3)"
    for rel, col in (("session", "trainer_id"), ("booking", "member_id"), ("progress", "member_id"), ("reviews", "member_id"))]


def _on_repeated(sql: str) -> str:
    return re.sub(r"\b(from|join) (booking|session|progress|reviews|users)\b", r"\1 r_\2", sql)


def _one(rel: str, sql: str) -> str:
    """Lookups by id read one row an id."""
    return sql.replace(f"join {rel} ", f"join o_{rel} ").replace(f"from {rel})", f"from o_{rel})")


_ONE = {rel: f"o_{rel} AS (select id, min(member_id) as member_id from r_{rel} group by id)" for rel in ("progress", "reviews")}
_BS = """
bs AS (select * from (select b.id as b_id, b.member_id as b_member, s.trainer_id as s_trainer,
                             row_number() over (partition by b.id order by b.member_id, s.trainer_id) as rn
                      from r_booking b join r_session s on b.session_id = s.id) q where rn = 1)"""
_TG7 = """
tg AS (select s.id as t_id, min(s.trainer_id) as trainer_id,
              s.id in (select session_id from r_reviews)
              or s.id in (select b.session_id from r_progress p join r_booking b on p.booking_id = b.id) as referenced
       from r_session s group by s.id)"""


def _register(key: str, run, requests: str, ctes: list[str], accepted: str, states: dict[str, str], view=lambda df: df):
    every = [CQ.REQUEST_CTES[requests], *_REPEATED, *ctes]
    register(f"{key}_broken_rejected", CQ._sql(every, CQ._REJ))(lambda s, d: run(s, d).rejected)
    register(f"{key}_broken_accepted", CQ._sql(every, accepted))(lambda s, d: view(run(s, d).accepted))
    for rel, select in states.items():
        name = f"{key}_broken_state" if len(states) == 1 else f"{key}_broken_{rel}_state"
        register(name, CQ._sql(every, _on_repeated(select)))(lambda s, d, rel=rel: run(s, d).states[rel])


def _run(op, frame, **how):
    def run(spark, d):
        t = tables(spark, d, "session", "booking", "progress")
        return op(frame(t), RQ.repeated(t), **how)
    return run


_GONE = "(select id from fin where reason is null)"
_register("m09_change_booking_status", _run(M.change_booking_status, RQ.status_change_requests), "status_req", [_BS, *CQ._M09[2:]],
          "select request_id, booking_id, status from fin where reason is null", {"booking": """
select b.id, b.session_id, b.member_id, coalesce(l.new_status, b.status) as status, b.datetime_created, b.member_name
from booking b left join last l on l.booking_id = b.id"""})
_register("m11_patch_progress", _run(M.patch_progress, RQ.progress_patches), "progress_patch",
          [_ONE["progress"], _one("progress", CQ._M11[1]), CQ._c11], CQ._PRESENT_SEL, {"progress": CQ._s11}, CQ._present_str)
_register("m14_patch_reviews", _run(M.patch_reviews, RQ.review_patches), "review_patch",
          [_ONE["reviews"], _one("reviews", CQ._M14[1]), CQ._c14], CQ._PRESENT_SEL, {"reviews": CQ._s14}, CQ._present_str)
_register("m12_delete_progress", _run(M.delete_progress, RQ.progress_deletes), "progress_del",
          [_ONE["progress"], *[_one("progress", c) for c in CQ._M12[1:]]], CQ._ACC, {"progress": f"select * from progress where id not in {_GONE}"})
_register("m15_delete_reviews", _run(M.delete_reviews, RQ.review_deletes), "review_del",
          [_ONE["reviews"], *[_one("reviews", c) for c in CQ._M15[1:]]], CQ._ACC, {"reviews": f"select * from reviews where id not in {_GONE}"})
_register("m07_delete_sessions", _run(M.delete_sessions, RQ.session_deletes), "session_del", [_TG7, *CQ._M07[2:]], CQ._ACC,
          {"session": f"select * from session where id not in {_GONE}", "booking": f"select * from booking where session_id not in {_GONE}"})
for _mode in ("restrict", "cascade"):
    _M18 = CQ._delete_sql("user_del", f"tg AS (select distinct u.id as t_id, u.id in ({_on_repeated(CQ._REFS[_mode])}) as referenced from r_users u)",
                          f"not {CQ._ADMIN}", [("referenced", "tg.referenced")])
    _register(f"m18_delete_users_{_mode}", _run(M.delete_users, RQ.user_deletes, mode=_mode), "user_del", _M18[1:], CQ._ACC,
              {"users": f"select * from users where id not in {_GONE}"})
