"""Batch change operators.

Every handler that writes in the reference becomes one operator over a
frame of requests. Requests carry ``request_id``, ``request_ts``,
``actor_role``, ``actor_id`` and the body. The result holds

* ``accepted``: the requests that take effect, with the rows they write;
* ``rejected``: ``(request_id, reason)``, the reason being the *first*
  failing check in the reference's order;
* ``states``: the new state of every relation the operator changes;
* ``deltas``: the same change as the ids it touches and the rows that stand for
  them afterwards, so a store need not write what stays (``sources.buckets``).

Checks are joins and column predicates folded by ``first_failing``; nothing
is evaluated per row in Python and nothing loops on the driver. Within a
batch, requests are ordered by ``(request_ts, request_id)``. Where the
reference's outcome depends on earlier requests of the same batch (a second
booking of one seat, a second review, a second delete), the earliest
eligible request per business key is found with an aggregate (``min`` of a
struct, combined map-side, so a hot key costs one partial row per task) and
every request that passed the checks before compares itself with it. The
aggregate is exchanged anew for that join (``_apart``), so AQE's skew join
can split a hot key. Nothing runs while a plan is built, but for the id
assignment of inserts, the claims on emails (M16) and, where a delta names
them many times, the accepted requests, when they are read. Identity-changing checks compare ``(role, id)``, never a bare
id (customer 5 and trainer 5 are different principals).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collation import norm_key
from ..functions.columns import first_failing, in_domain, js_or, rating_value, truthy
from ..plans.session import write_once
from ..sources.schema import (ADMIN, BOOKING, BOOKING_STATUSES, PROGRESS, REVIEWS, SESSION, SESSION_STATUSES,
                              TRAINER, USERS, Tables, conform)
from .claims import settle_claims
from .ids import assign_ids, max_id

C = F.col
TS, RID = "request_ts", "request_id"

# Patchable fields, in the order the handlers check them.
SESSION_PATCH_FIELDS = ("title", "deskripsi", "trainer_id", "start_time", "end_time", "price", "status")
PROGRESS_PATCH_FIELDS = ("activity", "duration", "note")
REVIEW_PATCH_FIELDS = ("rating_score", "comment")
STAFF = ("trainer", "admin")
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
# Places for rows that meet no winner: more than a shuffle has tasks.
ASIDE = 1 << 20


@dataclass(frozen=True)
class Delta:
    """All rows of ``ids`` (a column ``id``, repeats allowed) are replaced by
    ``rows``, whose ids are among them."""

    ids: DataFrame
    rows: DataFrame


class Change:
    """Result of a change operator. Its parts may be given as zero-argument
    callables: inserts assign ids (a range-partitioned checkpoint plus a count
    job), merges settle claims in rounds, and a caller that doesn't read a
    part should not pay for it. Each is computed once, on first access."""

    def __init__(self, accepted, rejected, states=None, deltas=None):
        self._accepted, self._rejected, self._states = accepted, rejected, states if states is not None else {}
        self._deltas = deltas if deltas is not None else {}

    @cached_property
    def rejected(self) -> DataFrame:
        return self._rejected() if callable(self._rejected) else self._rejected

    @cached_property
    def accepted(self) -> DataFrame:
        return self._accepted() if callable(self._accepted) else self._accepted

    @cached_property
    def states(self) -> dict[str, DataFrame]:
        return self._states() if callable(self._states) else self._states

    @cached_property
    def deltas(self) -> dict[str, Delta]:
        return self._deltas() if callable(self._deltas) else self._deltas


# ------------------------------------------------------------------ helpers

def _order() -> list[Column]:
    return [C(TS).asc(), C(RID).asc()]


def _after(ts: Column, rid: Column) -> Column:
    """This request comes after the one at ``(ts, rid)`` in batch order."""
    return (C(TS) > ts) | ((C(TS) == ts) & (C(RID) > rid))


def _apart(name: str, *cols) -> Column:
    """Always 0, which the planner can't know. An aggregate leaves its rows
    partitioned by its keys, and so does a join; the next join on those keys
    would read them as they lie, and AQE splits a hot key only where both
    inputs of a join are exchanges and no later step relies on its
    partitioning. With this column among the keys of the join called ``name``
    both sides are exchanged for it: a batch is shuffled once more, and no
    key of it has to fit one task."""
    return F.pmod(F.xxhash64(*cols, F.lit(name)), F.lit(1))


def _reduce(big: DataFrame, small: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Semi-join reduction: the rows of ``big`` whose columns (right of each
    pair) equal those of some row of ``small`` (left of each pair). Spark
    chooses the join from its own sizes."""
    keys = small.select(*[C(s_).alias(f"__red{i}") for i, (s_, _) in enumerate(pairs)])
    cond = None
    for i, (_, b) in enumerate(pairs):
        c = C(b) == C(f"__red{i}")
        cond = c if cond is None else cond & c
    return big.join(keys, cond, "left_semi")


def _replaced(state: DataFrame, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Delta:
    """The rows of ``ids`` as ``change`` leaves them."""
    return Delta(ids, change(_reduce(state, ids, [("id", "id")])))


def _without(state: DataFrame, gone: DataFrame, column: str = "id") -> DataFrame:
    return state.join(gone, C(column) == C("del_id"), "left_anti")


def _removed(state: DataFrame, gone: DataFrame, column: str = "id") -> Delta:
    """The rows whose ``column`` is among ``gone`` go. Where ids repeat, other
    rows of their ids stay."""
    ids = gone.select(C("del_id").alias("id"))
    if column != "id":
        ids = _reduce(state.select("id", column), gone, [("del_id", column)]).select("id")
    return _replaced(state, ids, lambda held: _without(held, gone, column))


def _flag(df: DataFrame, other: DataFrame, pairs: Sequence[tuple[str, str]], name: str,
          by: DataFrame | None = None) -> DataFrame:
    """Left-join a boolean ``name``: does ``other`` hold a row whose columns
    equal ``df``'s on every pair? ``other`` is first reduced to the keys the
    requests (``by``, default ``df``) ask about, then to distinct keys, so
    the state is never aggregated whole and the join never fans out."""
    other = _reduce(other, df if by is None else by, pairs)
    mine = [f"__{name}_{i}" for i in range(len(pairs))]
    keys = other.select(*[C(o).alias(m) for m, (_, o) in zip(mine, pairs)]).distinct()
    keys = keys.withColumn(name, F.lit(True)).withColumn("__apart", _apart(name, *mine))
    cond = _apart(name, *[C(d) for d, _ in pairs]) == C("__apart")
    for m, (d, _) in zip(mine, pairs):
        cond = cond & (C(d) == C(m))
    out = df.join(keys, cond, "left").drop(*mine, "__apart")
    return out.withColumn(name, F.coalesce(C(name), F.lit(False)))


def _join_one(requests: DataFrame, state: DataFrame, key: str, name: str, reduced: bool = False) -> DataFrame:
    """Left-join the row that a request's ``key`` names by ``id``: the other
    columns of ``state``, and ``<name>_found``. Of several rows of an id (the
    state is broken then, Q1) the least by those columns counts, so a request
    stays one request. ``reduced``: the state holds only the batch's ids."""
    rest = [c for c in state.columns if c != "id"]
    held = state if reduced else _reduce(state, requests, [(key, "id")])
    one = (held.groupBy(C("id").alias(f"__{name}_id")).agg(F.min(F.struct(*(rest or ["id"]))).alias(f"__{name}"))
           .withColumn("__apart", _apart(name, f"__{name}_id")))
    out = requests.join(one, (C(key) == C(f"__{name}_id")) & (_apart(name, key) == C("__apart")), "left")
    return out.select(*requests.columns, C(f"__{name}_id").isNotNull().alias(f"{name}_found"), *[C(f"__{name}.{c}").alias(c) for c in rest])


def _first_wins(j: DataFrame, eligible: Column, asks: Column, keys: Sequence[str],
                carry: Sequence[str] = ()) -> DataFrame:
    """Attach the earliest eligible request per ``keys`` as ``w_ts``, ``w_id``
    and, for ``carry``, ``w_<column>``.

    Only eligible rows are aggregated, by their order key and what is
    carried (combined map-side, so a hot key costs one partial row per task).
    Only rows that ``asks`` holds for meet the winners. The others can't be
    changed by one: in the join they lie apart, dealt by request, so blank or
    missing keys never gather and the checks before run for winners and rows,
    not for the others once more."""
    asks = F.coalesce(asks, F.lit(False))
    win = (j.filter(eligible).groupBy(*keys)
           .agg(F.min(F.struct(C(TS).alias("ts"), C(RID).alias("id"), *carry)).alias("__w"))
           .select(*[C(k).alias(f"__w_{k}") for k in keys], "__w", _apart("winner", *keys).alias("__apart")))
    aside = F.pmod(F.xxhash64(RID), F.lit(ASIDE)) + 1
    cond = F.when(asks, _apart("winner", *keys)).otherwise(aside) == C("__apart")
    for k in keys:
        cond = cond & (C(k) == C(f"__w_{k}"))
    met = j.join(win, cond, "left")
    return met.select(*j.columns, *[C(f"__w.{n}").alias(f"w_{n}") for n in ["ts", "id", *carry]])


def _split(j: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests (the accepted side of an insert is cut
    by the id assignment's checkpoint)."""
    j = j.withColumn("reason", reason)
    return j.filter(C("reason").isNull()).drop("reason"), j.filter(C("reason").isNotNull()).select(RID, "reason")


def _is_owner(role: str, owner_col: str) -> Column:
    return F.coalesce((C("actor_role") == role) & C("actor_id").eqNullSafe(C(owner_col)), F.lit(False))


def _is_admin() -> Column:
    return F.coalesce(C("actor_role") == "admin", F.lit(False))


def _insert(accepted: DataFrame, state: DataFrame, schema, floor: int, **cols: Column) -> tuple[DataFrame, DataFrame]:
    """Give accepted inserts dense ids after the largest id ever given (M1):
    the table's maximum or ``floor``, the published high-water mark, so the id
    of a deleted row is not given again. Returns ``(accepted rows with ids,
    new state)``."""
    top = max(max_id(state), floor)
    shaped = accepted.select(RID, TS, *[v.alias(k) for k, v in cols.items()])
    with_ids = assign_ids(shaped, top, _order()).drop(TS)
    new_state = state.unionByName(conform(with_ids, schema))
    return with_ids, new_state


def _insert_change(accepted: DataFrame, rejected: DataFrame, state: DataFrame, relation: str, schema,
                   floor: int, **cols: Column) -> Change:
    """A Change whose accepted rows and new state are built (ids assigned)
    only when first read."""
    memo: dict = {}

    def build():
        if "v" not in memo:
            memo["v"] = _insert(accepted, state, schema, floor, **cols)
        return memo["v"]
    return Change(lambda: build()[0], rejected, lambda: {relation: build()[1]},
                  lambda: {relation: Delta(build()[0].select("id"), conform(build()[0], schema))})


def _present(f: str) -> Column:
    return F.coalesce(F.array_contains(C("present"), f), F.lit(False))


def _integer(c: str) -> Column:
    """Digits that the INT column can hold."""
    return F.coalesce(C(c).rlike(INTEGER_TEXT) & F.trim(C(c)).try_cast("int").isNotNull(), F.lit(False))


def _named_null(*fields: str) -> Column:
    """A patch names one of the fields and gives NULL."""
    out = F.lit(False)
    for f in fields:
        out = out | (_present(f) & C(f).isNull())
    return out


def apply_patches(state: DataFrame, accepted: DataFrame, fields: Sequence[str], touch: str | None = None) -> DataFrame:
    """Last write per field: for every field, the value of the latest
    accepted patch (by ``(request_ts, request_id)``) that names it in
    ``present``; a field no patch names keeps its value. An explicit NULL in a
    named field is written. ``touch``: column set to the latest accepted
    patch time of a row whose values changed (``ON UPDATE`` semantics)."""
    order = F.struct(C(TS), C(RID))
    aggs = []
    for f in fields:
        aggs.append(F.max(_present(f)).alias(f"__has_{f}"))
        aggs.append(F.max_by(C(f), F.when(_present(f), order)).alias(f"__new_{f}"))
    agg = accepted.groupBy(C("id").alias("__pid")).agg(*aggs, F.max(TS).alias("__last_ts"))
    j = state.join(agg, C("id") == C("__pid"), "left")
    new = {f: F.when(F.coalesce(C(f"__has_{f}"), F.lit(False)), C(f"__new_{f}")).otherwise(C(f)) for f in fields}
    cols = []
    for c in state.columns:
        if c in new:
            cols.append(new[c].cast(state.schema[c].dataType).alias(c))
        elif c == touch:
            changed = None
            for f in fields:
                d = ~new[f].eqNullSafe(C(f))
                changed = d if changed is None else changed | d
            cols.append(F.when(C("__pid").isNotNull() & changed, C("__last_ts")).otherwise(C(c)).alias(c))
        else:
            cols.append(C(c))
    return j.select(*cols)


def _patch_change(accepted: DataFrame, rejected: DataFrame, relation: str, state: DataFrame, fields: Sequence[str],
                  touch: str | None = None) -> Change:
    def delta() -> Delta:
        told = write_once(accepted.select(RID, TS, "id", "present", *fields))
        return _replaced(state, told.select("id"), lambda held: apply_patches(held, told, fields, touch))
    return Change(accepted.select(RID, "id", "present"), rejected, {relation: apply_patches(state, accepted, fields, touch)},
                  lambda: {relation: delta()})


def _deletes(requests: DataFrame, target: DataFrame, checks, not_found: str = "not_found",
             early: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared delete flow. ``checks(j)`` gives the ordered checks after the
    existence check. Requests after the first accepted delete of an id see
    the row gone and get ``not_found`` (unless an ``early`` check, one that
    precedes the existence check, already rejects them)."""
    j = _join_one(requests, target, "id", "t")
    pre = [(r, c) for r, c in checks(j) if r in early]
    post = [(r, c) for r, c in checks(j) if r not in early]
    base = first_failing([*pre, (not_found, ~C("t_found")), *post])
    j = j.withColumn("base", base)
    early_hit = F.coalesce(C("base").isin(*early), F.lit(False)) if early else F.lit(False)
    # An absent row has no winner: its requests are settled already.
    asks = ~early_hit & (C("base").isNull() | (C("base") != not_found))
    j = _first_wins(j, C("base").isNull(), asks, ["id"])
    gone = C("w_ts").isNotNull() & _after(C("w_ts"), C("w_id"))
    reason = F.when(early_hit, C("base")).when(gone, F.lit(not_found)).otherwise(C("base"))
    accepted, rejected = _split(j, reason)
    return accepted.select(RID, TS, "id"), rejected, accepted.select(C("id").alias("del_id")).distinct()


def _removal(accepted: DataFrame, rejected: DataFrame, t: Tables, gone: DataFrame, by: dict[str, str]) -> Change:
    """``gone`` leaves every relation of ``by``, found there in its column."""
    def deltas() -> dict[str, Delta]:
        told = write_once(gone)
        return {rel: _removed(getattr(t, rel), told, col) for rel, col in by.items()}
    return Change(accepted, rejected, {rel: _without(getattr(t, rel), gone, col) for rel, col in by.items()}, deltas)


# ------------------------------------------------------------------ M8

def admit_bookings(requests: DataFrame, t: Tables) -> Change:
    """M8: checks in the reference's order, then in-batch seat contention.

    1 session_id falsy -> session_id_required; 2 actor not a customer row ->
    customer_not_found; 3 session absent, cancelled/completed or trainer
    absent -> session_unavailable; 4 start before the request ->
    already_started; 5 a non-Cancel booking of the pair exists ->
    already_booked; 6 a Cancel booking exists (the UNIQUE key refuses the
    insert) -> unique_key_conflict; 7 status outside the enum ->
    invalid_status. Among requests passing 1-7 the earliest per (session,
    member) wins; a later one gets already_booked, or unique_key_conflict if
    the winner's status is Cancel. A missing (NULL) status means the default
    'Pending'."""
    req = requests.withColumn("status", F.coalesce(C("status"), F.lit("Pending")))
    # Every state relation is first reduced to the keys the batch asks about.
    users = _reduce(t.users, req, [("actor_id", "id")]).select(C("id").alias("u_id"), C("nama").alias("u_nama"))
    asked = _reduce(t.session.filter(~C("status").isin("cancelled", "completed")), req, [("session_id", "id")])
    trainers = _reduce(t.trainer, asked, [("trainer_id", "id")]).select(C("id").alias("tr_id"))
    avail = (asked.join(trainers, C("trainer_id") == C("tr_id"), "left_semi")
             .select(C("id").alias("s_id"), C("start_time").alias("s_start")))
    # One row per (session, member) of the state; the state may already hold
    # duplicates, which must not fan requests out.
    pairs = (_reduce(t.booking, req, [("session_id", "session_id"), ("actor_id", "member_id")])
             .groupBy(C("session_id").alias("e_sid"), C("member_id").alias("e_mid"))
             .agg(F.bool_or(F.coalesce(C("status") != "Cancel", F.lit(False))).alias("live"))
             .withColumn("e_apart", _apart("pairs", "e_sid", "e_mid")))
    j = (req.join(users, C("actor_id") == C("u_id"), "left")
         .join(avail, C("session_id") == C("s_id"), "left")
         .join(pairs, (C("session_id") == C("e_sid")) & (C("actor_id") == C("e_mid"))
               & (_apart("pairs", "session_id", "actor_id") == C("e_apart")), "left"))
    base = first_failing([
        ("session_id_required", ~truthy("session_id", numeric=True)),
        ("customer_not_found", C("u_id").isNull()),
        ("session_unavailable", C("s_id").isNull()),
        ("already_started", C("s_start") < C(TS)),
        ("already_booked", C("live") == F.lit(True)),
        ("unique_key_conflict", C("live") == F.lit(False)),
    ])
    j = j.withColumn("base", base).withColumn("ok", in_domain("status", BOOKING_STATUSES))
    j = _first_wins(j.select(RID, TS, "actor_id", "session_id", "status", "u_nama", "base", "ok"),
                    C("base").isNull() & C("ok"), C("base").isNull(), ["session_id", "actor_id"], ["status"])
    dup = F.when(C("w_ts").isNotNull() & _after(C("w_ts"), C("w_id")),
                 F.when(C("w_status") != "Cancel", F.lit("already_booked")).otherwise(F.lit("unique_key_conflict")))
    reason = F.coalesce(C("base"), dup, F.when(~C("ok"), F.lit("invalid_status")))
    accepted, rejected = _split(j, reason)
    return _insert_change(accepted, rejected, t.booking, "booking", BOOKING, t.floor("booking"), session_id=C("session_id"),
                          member_id=C("actor_id"), status=C("status"), datetime_created=C(TS),
                          member_name=C("u_nama"))


# ------------------------------------------------------------------ M9

def change_booking_status(requests: DataFrame, t: Tables) -> Change:
    """M9: status in the enum -> booking exists (with its session) ->
    customer: own booking and only to Cancel -> trainer: own session -> admin
    (or any other role): allowed. Authorisation never reads the current
    status, so requests are independent; the last accepted one per booking
    (by ``(request_ts, request_id)``) sets the status."""
    asked = _reduce(t.booking, requests, [("booking_id", "id")])
    b = asked.join(t.session.select(C("id").alias("s_id"), C("trainer_id").alias("s_trainer")),
                   C("session_id") == C("s_id")).select("id", C("member_id").alias("b_member"), "s_trainer")
    j = _join_one(requests, b, "booking_id", "b", reduced=True)
    reason = first_failing([
        ("invalid_status", ~in_domain("status", BOOKING_STATUSES)),
        ("booking_not_found", ~C("b_found")),
        ("unauthorized", (C("actor_role") == "customer")
         & (~C("actor_id").eqNullSafe(C("b_member")) | (C("status") != "Cancel"))),
        ("not_your_session", (C("actor_role") == "trainer") & ~C("actor_id").eqNullSafe(C("s_trainer"))),
    ])
    accepted, rejected = _split(j, reason)
    last = accepted.groupBy(C("booking_id").alias("u_bid")).agg(
        F.max_by(C("status"), F.struct(C(TS), C(RID))).alias("new_status"))

    def changed(state, last):
        return (state.join(last, C("id") == C("u_bid"), "left")
                .withColumn("status", F.coalesce(C("new_status"), C("status"))).select(*t.booking.columns))

    def delta() -> Delta:
        told = write_once(last)
        return _replaced(t.booking, told.select(C("u_bid").alias("id")), lambda held: changed(held, told))
    return Change(accepted.select(RID, "booking_id", "status"), rejected, {"booking": changed(t.booking, last)},
                  lambda: {"booking": delta()})


# ------------------------------------------------------------------ M13

def admit_reviews(requests: DataFrame, t: Tables) -> Change:
    """Actor is a customer -> session_id and rating truthy -> 1 <= rating
    <= 5 -> a Confirmed booking of the actor for the session -> no review of
    the pair yet -> insert (rating rounded on store, blank comment -> NULL).
    In a batch, the earliest passing request per (session, member) wins and
    later ones get already_reviewed. The session need not be over."""
    conf = t.booking.filter(C("status") == "Confirmed")
    j = _flag(requests, conf, [("session_id", "session_id"), ("actor_id", "member_id")], "has_conf")
    j = _flag(j, t.reviews, [("session_id", "session_id"), ("actor_id", "member_id")], "has_review", by=requests)
    r = C("rating_score")
    base = first_failing([
        ("not_customer", F.coalesce(C("actor_role") != "customer", F.lit(True))),
        ("fields_required", ~truthy("session_id", numeric=True) | ~truthy(r, numeric=True)),
        ("rating_out_of_range", (r < 1) | (r > 5)),
        ("no_confirmed_booking", ~C("has_conf")),
        ("already_reviewed", C("has_review")),
    ])
    j = _first_wins(j.withColumn("base", base), C("base").isNull(), C("base").isNull(), ["session_id", "actor_id"])
    reason = F.coalesce(C("base"), F.when(C("w_ts").isNotNull() & _after(C("w_ts"), C("w_id")),
                                          F.lit("already_reviewed")))
    accepted, rejected = _split(j, reason)
    return _insert_change(accepted, rejected, t.reviews, "reviews", REVIEWS, t.floor("reviews"), session_id=C("session_id"),
                          member_id=C("actor_id"), rating_score=rating_value(r),
                          comment=F.nullif(C("comment"), F.lit("")), datetime_created=C(TS))


# ------------------------------------------------------------------ M10

def admit_progress(requests: DataFrame, t: Tables) -> Change:
    """Actor is a customer -> activity, duration, note truthy -> a truthy
    booking_id must be a Confirmed booking of the actor -> duration must be
    an integer that fits the INT column ('30 mins' and 3000000000 are
    refused; '0' is text and truthy, so it is stored) -> insert; a falsy
    booking_id (0, '') is stored as NULL."""
    own = t.booking.filter(C("status") == "Confirmed")
    j = _flag(requests, own, [("booking_id", "id"), ("actor_id", "member_id")], "own_conf")
    reason = first_failing([
        ("not_customer", F.coalesce(C("actor_role") != "customer", F.lit(True))),
        ("fields_required", ~truthy("activity") | ~truthy("duration") | ~truthy("note")),
        ("booking_not_confirmed", truthy("booking_id", numeric=True) & ~C("own_conf")),
        ("invalid_duration", ~_integer("duration")),
    ])
    accepted, rejected = _split(j, reason)
    return _insert_change(accepted, rejected, t.progress, "progress", PROGRESS, t.floor("progress"), member_id=C("actor_id"),
                          booking_id=F.when(truthy("booking_id", numeric=True), C("booking_id")),
                          activity=C("activity"), duration=F.trim(C("duration")).try_cast("int"),
                          note=C("note"), jam_nyatat=C(TS))


# ------------------------------------------------------------------ M5

def admit_sessions(requests: DataFrame, t: Tables) -> Change:
    """M5: actor is trainer or admin -> title, trainer_id, start_time truthy ->
    trainer exists -> status (default 'scheduled') in the enum -> insert."""
    req = requests.withColumn("status", F.coalesce(C("status"), F.lit("scheduled")))
    j = _flag(req, t.trainer, [("trainer_id", "id")], "trainer_ok")
    reason = first_failing([
        ("forbidden", ~F.coalesce(C("actor_role").isin(*STAFF), F.lit(False))),
        ("fields_required", ~truthy("title") | ~truthy("trainer_id", numeric=True) | C("start_time").isNull()),
        ("trainer_not_found", ~C("trainer_ok")),
        ("invalid_status", ~in_domain("status", SESSION_STATUSES)),
    ])
    accepted, rejected = _split(j, reason)
    return _insert_change(accepted, rejected, t.session, "session", SESSION, t.floor("session"), title=C("title"),
                          deskripsi=C("deskripsi"), trainer_id=C("trainer_id"), start_time=C("start_time"),
                          end_time=C("end_time"), price=C("price"), status=C("status"))


# ------------------------------------------------------------------ patches M6, M11, M14

def patch_sessions(requests: DataFrame, t: Tables) -> Change:
    """M6: actor trainer or admin (route guard) -> fields in list order:
    trainer_id named and not an existing trainer -> invalid_trainer; status
    named and outside the enum -> invalid_status -> nothing named ->
    no_fields -> session absent -> not_found -> a named title or start_time is
    NULL -> not_null (the store refuses it). No owner check. Each patch is
    validated alone against the pre-batch state; accepted patches apply
    last-write-per-field and set ``updated_at`` where a value changed."""
    j = _flag(requests, t.trainer, [("trainer_id", "id")], "trainer_ok")
    j = _flag(j, t.session, [("id", "id")], "exists", by=requests)
    named = F.exists(C("present"), lambda x: x.isin(*SESSION_PATCH_FIELDS))
    reason = first_failing([
        ("forbidden", ~F.coalesce(C("actor_role").isin(*STAFF), F.lit(False))),
        ("invalid_trainer", _present("trainer_id") & ~C("trainer_ok")),
        ("invalid_status", _present("status") & ~in_domain("status", SESSION_STATUSES)),
        ("no_fields", ~F.coalesce(named, F.lit(False))),
        ("not_found", ~C("exists")),
        ("not_null", _named_null("title", "start_time")),
    ])
    accepted, rejected = _split(j, reason)
    return _patch_change(accepted, rejected, "session", t.session, SESSION_PATCH_FIELDS, touch="updated_at")


def patch_progress(requests: DataFrame, t: Tables) -> Change:
    """M11 (unrouted in the reference): row exists -> owner (customer with
    that member id) or admin -> any of activity, duration, note named ->
    a named duration must be an integer -> a named activity or note is NULL ->
    not_null (the store refuses it)."""
    j = _join_one(requests, t.progress.select("id", C("member_id").alias("p_member")), "id", "p")
    named = F.exists(C("present"), lambda x: x.isin(*PROGRESS_PATCH_FIELDS))
    reason = first_failing([
        ("not_found", ~C("p_found")),
        ("forbidden", ~_is_admin() & ~_is_owner("customer", "p_member")),
        ("no_fields", ~F.coalesce(named, F.lit(False))),
        ("invalid_duration", _present("duration") & ~_integer("duration")),
        ("not_null", _named_null("activity", "note")),
    ])
    accepted, rejected = _split(j, reason)
    accepted = accepted.withColumn("duration", F.trim(C("duration")).try_cast("int"))
    return _patch_change(accepted, rejected, "progress", t.progress, PROGRESS_PATCH_FIELDS)


def patch_reviews(requests: DataFrame, t: Tables) -> Change:
    """M14 (unrouted in the reference): a named rating outside 1..5 (a named
    NULL counts as 0 in the JS comparison) -> row exists -> author or admin
    -> rating_score or comment named. Ratings are rounded on store."""
    j = _join_one(requests, t.reviews.select("id", C("member_id").alias("r_member")), "id", "r")
    r = C("rating_score")
    named = F.exists(C("present"), lambda x: x.isin(*REVIEW_PATCH_FIELDS))
    reason = first_failing([
        ("rating_out_of_range", _present("rating_score") & F.coalesce((r < 1) | (r > 5), F.lit(True))),
        ("not_found", ~C("r_found")),
        ("forbidden", ~_is_admin() & ~_is_owner("customer", "r_member")),
        ("no_fields", ~F.coalesce(named, F.lit(False))),
    ])
    accepted, rejected = _split(j, reason)
    accepted = accepted.withColumn("rating_score", rating_value(r))
    return _patch_change(accepted, rejected, "reviews", t.reviews, REVIEW_PATCH_FIELDS)


# ------------------------------------------------------------------ deletes M7, M12, M15, M18

def delete_sessions(requests: DataFrame, t: Tables) -> Change:
    """M7: actor trainer or admin (route) -> session exists -> admin or the
    owning trainer -> not referenced by a review, nor by progress through one
    of its bookings (no cascade on those keys, so the transaction rolls
    back) -> delete its bookings, then the session, atomically."""
    base = _reduce(t.session.select("id", "trainer_id"), requests, [("id", "id")])
    # bookings of the asked sessions: not bounded by the batch (a session may
    # hold many), so the progress side is a plain join and AQE picks the plan
    bookings = _reduce(t.booking.select(C("id").alias("bk"), "session_id"), base, [("id", "session_id")])
    via_progress = (t.progress.filter(C("booking_id").isNotNull())
                    .join(bookings, C("booking_id") == C("bk")).select(C("session_id").alias("ref_sid")))
    referenced = t.reviews.select(C("session_id").alias("ref_sid")).unionByName(via_progress)
    target = _flag(base, referenced, [("id", "ref_sid")], "referenced")

    def checks(j):
        return [("forbidden", ~F.coalesce(C("actor_role").isin(*STAFF), F.lit(False))),
                ("not_owner", ~_is_admin() & ~_is_owner("trainer", "trainer_id")),
                ("referenced", C("referenced"))]
    accepted, rejected, gone = _deletes(requests, target, checks, early=("forbidden",))
    return _removal(accepted, rejected, t, gone, {"session": "id", "booking": "session_id"})


def delete_progress(requests: DataFrame, t: Tables) -> Change:
    """Row exists -> owner (customer with that member id) or admin."""
    def checks(j):
        return [("forbidden", ~_is_admin() & ~_is_owner("customer", "member_id"))]
    accepted, rejected, gone = _deletes(requests, t.progress.select("id", "member_id"), checks)
    return _removal(accepted, rejected, t, gone, {"progress": "id"})


def delete_reviews(requests: DataFrame, t: Tables) -> Change:
    """Row exists -> author or admin."""
    def checks(j):
        return [("forbidden", ~_is_admin() & ~_is_owner("customer", "member_id"))]
    accepted, rejected, gone = _deletes(requests, t.reviews.select("id", "member_id"), checks)
    return _removal(accepted, rejected, t, gone, {"reviews": "id"})


def delete_users(requests: DataFrame, t: Tables, mode: str = "restrict") -> Change:
    """Admin only -> user exists -> delete. ``restrict`` (the DDL):
    a user referenced by a booking, progress or review row is refused.
    ``cascade`` (what the v2 code comment claims): the user's bookings,
    progress and reviews go too; only another member's progress pointing at
    one of this user's bookings blocks it."""
    if mode not in ("restrict", "cascade"):
        raise ValueError(f"mode must be 'restrict' or 'cascade', not {mode!r}")
    base = _reduce(t.users.select("id"), requests, [("id", "id")])
    if mode == "restrict":
        refs = (t.booking.select(C("member_id").alias("ref"))
                .unionByName(t.progress.select(C("member_id").alias("ref")))
                .unionByName(t.reviews.select(C("member_id").alias("ref"))))
    else:
        owned = _reduce(t.booking.select(C("id").alias("bk"), C("member_id").alias("owner")), base,
                        [("id", "owner")])
        refs = (t.progress.filter(C("booking_id").isNotNull())
                .join(owned, C("booking_id") == C("bk"))
                .filter(C("owner") != C("member_id")).select(C("owner").alias("ref")))
    target = _flag(base, refs, [("id", "ref")], "referenced")

    def checks(j):
        return [("forbidden", ~_is_admin()), ("referenced", C("referenced"))]
    accepted, rejected, gone = _deletes(requests, target, checks, early=("forbidden",))
    by = {"users": "id"}
    if mode == "cascade":
        by |= dict.fromkeys(("booking", "progress", "reviews"), "member_id")
    return _removal(accepted, rejected, t, gone, by)


# ------------------------------------------------------------------ merges M16, M17

def _merged(state: DataFrame, accepted: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field, the last non-blank value of the accepted merges of a row."""
    order = F.struct(C(TS), C(RID))
    agg = accepted.groupBy(C("id").alias("__mid")).agg(
        *[F.max_by(C(f), F.when(truthy(f), order)).alias(f"__new_{f}") for f in fields])
    return state.join(agg, C("id") == C("__mid"), "left").select(
        *[js_or(C(f"__new_{c}"), C(c)).alias(c) if c in fields else C(c) for c in state.columns])


def _merge(requests: DataFrame, state: DataFrame, relation: str, fields: Sequence[str], allowed: Column, unique_email: bool) -> Change:
    j = _flag(requests, state, [("id", "id")], "exists")
    reason = first_failing([("forbidden", ~allowed), ("not_found", ~C("exists"))])
    accepted, rejected = _split(j, reason)
    if not unique_email:
        return Change(accepted.select(RID, "id"), rejected, {relation: _merged(state, accepted, fields)},
                      lambda: {relation: _replaced(state, accepted.select("id"), lambda held: _merged(held, accepted, fields))})
    memo: dict = {}

    def settled() -> tuple[DataFrame, DataFrame]:
        if not memo:
            claims = accepted.filter(truthy("email")).select(RID, TS, C("id").alias("row"), norm_key("email").alias("key"))
            granted = settle_claims(claims, state.select(C("id").alias("row"), norm_key("email").alias("key")), _order(), RID)
            lost = granted.filter(~C("granted")).select(RID)
            memo["accepted"] = accepted.join(lost, RID, "left_anti")
            memo["rejected"] = rejected.unionByName(lost.withColumn("reason", F.lit("duplicate_email")))
        return memo["accepted"], memo["rejected"]

    def delta() -> Delta:
        told = write_once(settled()[0].select(RID, TS, "id", *fields))
        return _replaced(state, told.select("id"), lambda held: _merged(held, told, fields))
    return Change(lambda: settled()[0].select(RID, "id"), lambda: settled()[1],
                  lambda: {relation: _merged(state, settled()[0], fields)},
                  lambda: {relation: delta()})


def merge_user_profiles(requests: DataFrame, t: Tables) -> Change:
    """The customer themself or an admin -> row exists -> nama, email,
    propinsi, kota; a blank or missing value keeps the old one (``a || b``).
    Several merges of one row: per field, the last non-blank value by
    ``(request_ts, request_id)``. A merge whose email another customer holds at
    that moment, after all merges before it, is refused whole (UNIQUE email),
    so a freed email can be taken by a later request of the batch and a chain
    of swaps comes out as if each request were served alone."""
    allowed = _is_admin() | _is_owner("customer", "id")
    return _merge(requests, t.users, "users", ("nama", "email", "propinsi", "kota"), allowed, unique_email=True)


def merge_trainer_profiles(requests: DataFrame, t: Tables) -> Change:
    """An admin or that trainer -> row exists -> + spesialisasi. The
    trainer relation has no declared UNIQUE email, so none is enforced."""
    allowed = _is_admin() | _is_owner("trainer", "id")
    return _merge(requests, t.trainer, "trainer", ("nama", "email", "spesialisasi", "propinsi", "kota"), allowed, unique_email=False)


# ------------------------------------------------------------------ registrations M2-M4

def _register(requests: DataFrame, state: DataFrame, schema, extra_checks: list, unique_email: bool,
              cols: dict, floor: int) -> Change:
    checks = [*extra_checks,
              ("fields_required", ~truthy("nama") | ~truthy("email") | ~F.coalesce(C("has_password"), F.lit(False)))]
    j = requests.withColumn("__ek", norm_key("email"))
    if unique_email:
        j = _flag(j, state.select(norm_key("email").alias("__sek")), [("__ek", "__sek")], "taken")
        checks.append(("duplicate_email", C("taken")))
    j = j.withColumn("base", first_failing(checks))
    if unique_email:
        j = _first_wins(j, C("base").isNull(), C("base").isNull(), ["__ek"])
        reason = F.coalesce(C("base"), F.when(C("w_ts").isNotNull() & _after(C("w_ts"), C("w_id")),
                                              F.lit("duplicate_email")))
    else:
        reason = C("base")
    accepted, rejected = _split(j, reason)
    return _insert_change(accepted, rejected, state, "state", schema, floor, **cols)


def register_customers(requests: DataFrame, t: Tables) -> Change:
    """M2: nama, email truthy and a password given -> email not taken
    (case-insensitive UNIQUE; within a batch the earliest wins) -> insert;
    propinsi and kota default to ''."""
    ch = _register(requests, t.users, USERS, [], True,
                   dict(nama=C("nama"), email=C("email"), propinsi=js_or("propinsi", F.lit("")),
                        kota=js_or("kota", F.lit("")), created_at=C(TS)), t.floor("users"))
    return Change(lambda: ch.accepted, ch.rejected, lambda: {"users": ch.states["state"]}, lambda: {"users": ch.deltas["state"]})


def register_trainers(requests: DataFrame, t: Tables, unique_email: bool = True) -> Change:
    """M3: as M2 plus spesialisasi (default ''). The reference declares no
    UNIQUE email for trainers; it is enforced unless ``unique_email=False``."""
    ch = _register(requests, t.trainer, TRAINER, [], unique_email,
                   dict(nama=C("nama"), email=C("email"), spesialisasi=js_or("spesialisasi", F.lit("")),
                        propinsi=js_or("propinsi", F.lit("")), kota=js_or("kota", F.lit(""))), t.floor("trainer"))
    return Change(lambda: ch.accepted, ch.rejected, lambda: {"trainer": ch.states["state"]}, lambda: {"trainer": ch.deltas["state"]})


def register_admins(requests: DataFrame, t: Tables, unique_email: bool = True) -> Change:
    """M4: admin actor only -> nama, email, password -> insert."""
    ch = _register(requests, t.admin, ADMIN, [("forbidden", ~_is_admin())], unique_email,
                   dict(nama=C("nama"), email=C("email")), t.floor("admin"))
    return Change(lambda: ch.accepted, ch.rejected, lambda: {"admin": ch.states["state"]}, lambda: {"admin": ch.deltas["state"]})
