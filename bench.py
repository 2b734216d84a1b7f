"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

1. ``load``: the driver tables are mapped to the domain relations (the
   adapter) and written once as parquet snapshots, the way the relations
   would be stored in production; timed on its own.
2. Each headline query reads the stored snapshot (so filters and column
   pruning reach the scan) and runs to the ``noop`` sink: one warm-up run,
   then the median of ``$BENCH_RUNS`` runs (default 5).

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rosterlake.operators import audit as Q  # noqa: E402
from rosterlake.operators import changes as M  # noqa: E402
from rosterlake.operators import lookup as LK  # noqa: E402
from rosterlake.operators import reports as R  # noqa: E402
from rosterlake.operators import rollups as A  # noqa: E402
from rosterlake.operators import search as P  # noqa: E402
from rosterlake.operators.ids import assign_ids  # noqa: E402
from rosterlake.plans.session import build_session  # noqa: E402
from rosterlake.sources import fixture_requests as RQ  # noqa: E402
from rosterlake.sources.adapter import AS_OF, driver_fixture  # noqa: E402
from rosterlake.sources.schema import load_tables, ntz  # noqa: E402
from rosterlake.sources.sinks import write_snapshot, write_tables  # noqa: E402


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffle_bytes_by_group(event_dir: str) -> dict[str, int]:
    """Sum of shuffle bytes written per job group, from Spark's event log."""
    stage_group, written = {}, {}
    paths = [os.path.join(d, f) for d, _, files in os.walk(event_dir) for f in files if not f.startswith(".")]
    for path in sorted(paths):
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    sid = ev.get("Stage ID")
                    written[sid] = written.get(sid, 0) + int(m.get("Shuffle Bytes Written", 0))
    out: dict[str, int] = {}
    for sid, n in written.items():
        g = stage_group.get(sid)
        if g:
            out[g] = out.get(g, 0) + n
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    event_dir = os.environ.get("BENCH_EVENTLOG") or tempfile.mkdtemp(prefix="rosterlake-events-")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="rosterlake-bench",
                          extra={"spark.driver.memory": os.environ.get("ROSTERLAKE_DRIVER_MEMORY", "16g"), "spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir,
                                 "spark.eventLog.compress": "false"})
    ckpt = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="rosterlake-bench-")
    snap = os.path.join(ckpt, f"bench-snapshot-{os.getpid()}-{int(time.time())}")

    t0 = time.perf_counter()
    fx = driver_fixture(spark, sf_dir)
    write_tables(fx.tables, snap)
    write_snapshot(fx.existing_booking, f"{snap}/existing_booking", ["session_id"])
    write_snapshot(fx.booking_request, f"{snap}/booking_request")
    load_sec = time.perf_counter() - t0

    t = load_tables(spark, snap)
    existing = spark.read.parquet(f"{snap}/existing_booking")
    requests = spark.read.parquet(f"{snap}/booking_request")
    as_of = ntz(AS_OF)

    headline = {
        "j07_session_participant_counts": lambda: R.session_participant_counts(t),
        "j13_upcoming_sessions_member_view": lambda: R.upcoming_sessions_member_view(t, as_of),
        "j12_upcoming_sessions": lambda: R.upcoming_sessions(t, as_of),
        "j10_trainer_schedule": lambda: R.trainer_schedule(t, as_of),
        "j01_customer_booking_history": lambda: R.customer_booking_history(t),
        "j03_matched_trainer_customer": lambda: R.matched_trainer_customer(t),
        "j04_member_progress_summary": lambda: R.member_progress_summary(t),
        "j09_session_reviews_summary": lambda: R.session_reviews_summary(t),
        "a01_user_stats": lambda: A.user_stats(t.account()),
        "a02_booking_stats": lambda: A.booking_stats(t.booking),
        "a03_session_stats": lambda: A.session_stats(t.session),
        "s09_account_directory": lambda: LK.account_directory(t),
        "p01_search_users": lambda: P.search_users(t.users, nama="0_1", email="example", sort="nama",
                                                   order="DESC", page=2, limit=15).rows,
        "m08_admit_bookings": lambda: M.admit_bookings(requests, t.with_(booking=existing)).rejected,
        "m09_change_booking_status": lambda: M.change_booking_status(RQ.status_change_requests(t), t)
        .states["booking"],
        "m13_admit_reviews": lambda: M.admit_reviews(RQ.review_requests(t), t).rejected,
        "q00_audit_summary": lambda: Q.audit_summary(Q.audit_all(t)),
        # The costly halves, not in ``value``: id assignment, accepted rows and new states.
        "m01_assign_ids": lambda: assign_ids(t.booking.drop("id"), 0, [F.col("datetime_created").asc(), F.col("session_id").asc(), F.col("member_id").asc()]),
        "p04_paginate_users": lambda: P.paginate(t.users, [F.col("nama").asc(), F.col("id").asc()], 20),
        "m07_delete_sessions_state": lambda: M.delete_sessions(RQ.session_deletes(t), t).states["session"],
        "m08_admit_bookings_accepted": lambda: M.admit_bookings(requests, t.with_(booking=existing)).accepted,
        "m08_admit_bookings_state": lambda: M.admit_bookings(requests, t.with_(booking=existing)).states["booking"],
        "m13_admit_reviews_state": lambda: M.admit_reviews(RQ.review_requests(t), t).states["reviews"],
        "m16_merge_user_profiles_state": lambda: M.merge_user_profiles(RQ.user_merges(t), t).states["users"],
    }
    names = list(headline)
    costly = set(names[names.index("q00_audit_summary") + 1:])  # ``value`` stays comparable with earlier rounds
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    timings = {}
    for name, build in headline.items():
        if only and name not in only:
            continue
        spark.sparkContext.setJobGroup(name, name)
        noop(build())                      # warm-up
        samples = []
        for _ in range(runs):
            s = time.perf_counter()
            noop(build())
            samples.append(time.perf_counter() - s)
        timings[name] = round(statistics.median(samples), 4)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    rows = {"booking": t.booking.count(), "session": t.session.count(), "progress": t.progress.count()}
    version = spark.version
    spark.stop()                           # flushes the event log
    try:
        shuffle = {k: v // (runs + 1) for k, v in shuffle_bytes_by_group(event_dir).items()}
    except Exception:  # timings are the contract; shuffle bytes are extra
        shuffle = {}
    print(json.dumps({
        "metric": "sum_of_median_query_sec", "value": round(sum(v for k, v in timings.items() if k not in costly), 4), "unit": "sec",
        "value_with_costly_halves": round(sum(timings.values()), 4),
        "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "load_sec": round(load_sec, 3), "cpus": cpus, "runs": runs, "rows": rows,
        "shuffle_bytes_per_run": shuffle, "spark": version,
    }))


if __name__ == "__main__":
    main()
