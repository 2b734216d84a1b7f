"""Visibility: which principal may see which rows (V1-V7).

Rules are data: for every resource, the scope each role gets — ``all``,
``own`` (rows whose owner column equals the principal's id) or ``none``.

* ``grants(principals)`` gives each role's scope of each resource; it is a
  projection (plus an ``explode`` over the fixed resource list), no join.
* ``visible_rows(report, principals, resource)`` gives the (principal, row)
  pairs for principals with scope ``own``: one equi-join on the owner key.
  Principals with scope ``all`` are not paired with every row (that would be
  a cross product); their grant says they read the report as it is.
* ``visible_for(report, role, id, resource)`` is the single-principal form:
  one filter.

The reference also defines a customer-only guard that no route uses (V7);
it adds no rule. Ownership compares ``(role, id)``: the reference compares
bare ids, so trainer 5 passes an own-row check meant for customer 5 (V6);
that exposure is reported by ``bare_id_exposure`` instead of reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

ALL, OWN, NONE = "all", "own", "none"

# Resource -> (admin, trainer, customer) scope, and for "own"
# the column holding the owner's id. Sources: the route guards and the
# handlers' own checks (a handler check wins over a looser route).
RULES: dict[str, tuple[str, str, str, str | None]] = {
    # V1 admin only
    "user_list": (ALL, NONE, NONE, None),
    "user_by_email": (ALL, NONE, NONE, None),
    "user_delete": (ALL, NONE, NONE, None),
    "booking_list": (ALL, NONE, NONE, None),
    "progress_list": (ALL, NONE, NONE, None),
    "review_list": (ALL, NONE, NONE, None),
    "stats": (ALL, NONE, NONE, None),
    "admin_register": (ALL, NONE, NONE, None),
    # V2 trainer or admin
    "session_write": (ALL, ALL, NONE, None),
    "matched_trainer_customer": (ALL, ALL, NONE, None),
    "member_progress_summary": (ALL, ALL, NONE, None),
    "session_roster": (ALL, ALL, NONE, None),
    # V3 own rows or admin
    "customer_booking_history": (ALL, NONE, OWN, "customer_id"),
    "member_progress_summary_for": (ALL, NONE, OWN, "member_id"),
    "booking_by_id": (ALL, NONE, OWN, "member_id"),
    "user_by_id": (ALL, NONE, OWN, "id"),
    "my_bookings": (NONE, NONE, OWN, "member_id"),
    "my_progress": (NONE, NONE, OWN, "member_id"),
    "own_profile": (OWN, OWN, OWN, "id"),
    # V4 trainers see their own schedule and sessions; customers and admins any
    "trainer_schedule": (ALL, OWN, ALL, "trainer_id"),
    "trainer_sessions": (ALL, OWN, ALL, "trainer_id"),
    # V5 any signed-in principal / public
    "session_reviews_summary": (ALL, ALL, ALL, None),
    "upcoming_sessions": (ALL, ALL, ALL, None),
    "session_catalog": (ALL, ALL, ALL, None),
    "trainer_search": (ALL, ALL, ALL, None),
    "session_reviews": (ALL, ALL, ALL, None),
}


#: Resources whose rows belong to principals of several roles: the column
#: that says which role's id the owner column holds.
ROLE_COLUMN = {"own_profile": "role"}


def scope_of(role: Column, resource: str) -> Column:
    a, t, c, _ = RULES[resource]
    return F.when(role == "admin", a).when(role == "trainer", t).when(role == "customer", c).otherwise(NONE)


def grants(principals: DataFrame, resources: list[str] | None = None) -> DataFrame:
    """``(role, resource, scope)`` for every role that the principals have;
    the scope depends on nothing else, so principals aren't listed."""
    names = resources or list(RULES)
    p = principals.select("role").distinct().withColumn("resource", F.explode(F.array(*[F.lit(r) for r in names])))
    scope = None
    for r in names:
        s = scope_of(C("role"), r)
        scope = F.when(C("resource") == r, s) if scope is None else scope.when(C("resource") == r, s)
    return p.withColumn("scope", scope)


def _pairs(report: DataFrame, principals: DataFrame, resource: str, scope: str) -> DataFrame:
    """(viewer_role, viewer_id, row) for principals of ``scope`` whose id is
    the row's owner id, and whose role is the owner's where the row says."""
    owner = RULES[resource][3]
    if owner is None:
        return report.limit(0).select(F.lit(None).cast("string").alias("viewer_role"),
                                      F.lit(None).cast("bigint").alias("viewer_id"), *report.columns)
    p = (principals.select(C("role").alias("viewer_role"), C("id").alias("viewer_id")).distinct()
         .filter(scope_of(C("viewer_role"), resource) == scope))
    on = C("viewer_id") == C(owner)
    if scope == OWN and resource in ROLE_COLUMN:
        on = on & (C("viewer_role") == C(ROLE_COLUMN[resource]))
    return p.join(report, on).select("viewer_role", "viewer_id", *report.columns)


def visible_rows(report: DataFrame, principals: DataFrame, resource: str) -> DataFrame:
    """(viewer_role, viewer_id, row) for principals whose scope is ``own``."""
    return _pairs(report, principals, resource, OWN)


def visible_for(report: DataFrame, role: str, principal_id: int, resource: str) -> DataFrame:
    """Single principal: the report itself, its own rows, or nothing."""
    a, t, c, owner = RULES[resource]
    scope = {"admin": a, "trainer": t, "customer": c}.get(role, NONE)
    if scope == ALL:
        return report
    if scope == OWN:
        mine = report.filter(C(owner) == F.lit(principal_id))
        return mine.filter(C(ROLE_COLUMN[resource]) == role) if resource in ROLE_COLUMN else mine
    return report.limit(0)


def bare_id_exposure(report: DataFrame, principals: DataFrame, resource: str) -> DataFrame:
    """V6: (viewer_role, viewer_id, row) pairs that a bare-id owner check
    would let through but the ``(role, id)`` check refuses: a principal of a
    role without ``own`` scope whose id equals the row's owner id."""
    return _pairs(report, principals, resource, NONE)
