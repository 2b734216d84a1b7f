"""Change operators through id buckets (``*_stored``).

The relations are written in buckets, the change is applied to what is read back
from them, its delta is written to the touched buckets, and the relation read
after that must be the whole new state: the oracle is that of ``*_state``.
"""

from __future__ import annotations

import uuid

from rosterlake.operators import changes as M
from rosterlake.plans.session import ensure_checkpoint_dir
from rosterlake.sources import fixture_requests as RQ
from rosterlake.sources.buckets import change_buckets, create_buckets, read_buckets

from . import change_queries, repeated_queries  # noqa: F401  (their states are the oracles)
from .registry import REGISTRY, fx, register, tables

# Narrow, so that the given tables fill many buckets.
WIDTH = 512
# Every relation goes to buckets and requests come from them as well.
KEPT = ("session", "booking", "progress")


def _stored(spark, t, op, requests, relation, **how):
    root = f"{ensure_checkpoint_dir(spark)}/rosterlake-db/{uuid.uuid4().hex}"
    create_buckets(spark, root, t, WIDTH)
    change_buckets(spark, root, op(requests, read_buckets(spark, root), **how).deltas)
    return getattr(read_buckets(spark, root), relation)


def _register(key: str, op, frame, relation: str, state: str | None = None, held=lambda t: t, **how):
    state = state or f"{key}_state"

    def run(spark, d):
        t = tables(spark, d, *KEPT)
        return _stored(spark, held(t), op, frame(t), relation, **how)
    register(state.replace("_state", "_stored"), REGISTRY[state][1])(run)


def _bookings(spark, d):
    f = fx(spark, d, *KEPT)
    return _stored(spark, f.tables.with_(booking=f.existing_booking), M.admit_bookings, f.booking_request, "booking")


register("m08_admit_bookings_stored", REGISTRY["m08_admit_bookings_state"][1])(_bookings)
_register("m06_patch_sessions", M.patch_sessions, RQ.session_patches, "session")
_register("m09_change_booking_status", M.change_booking_status, RQ.status_change_requests, "booking")
_register("m16_merge_user_profiles", M.merge_user_profiles, RQ.user_merges, "users")
_register("m18_delete_users_cascade", M.delete_users, RQ.user_deletes, "booking", mode="cascade")
# A state in which ids repeat: other rows of a touched id stay.
_register("m07_delete_sessions", M.delete_sessions, RQ.session_deletes, "booking", "m07_delete_sessions_broken_booking_state", RQ.repeated)
