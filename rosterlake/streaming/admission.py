"""Change requests as Structured Streaming jobs.

The reference applies one change per HTTP call. Here requests arrive as
files; each micro-batch is applied with the batch operator (M2-M18) against
the store as of the previous version and published as the next one:

* insert operators (registrations, session/booking/progress/review
  admission) add their accepted rows to the relation;
* patch, status-change, merge and delete operators replace the relations
  they change.

A store of versions (``sources.sinks``) writes a changed relation whole; a store
of id buckets (``sources.buckets``, ``buckets=True``) writes the touched buckets.

The streaming checkpoint (on shared storage) and the manifest, which names
each writer's last epoch, give exactly-once publication: a replayed epoch is
found there before anything is evaluated, and writes nothing. Inside one micro-batch the batch rules apply (order by
``(request_ts, request_id)``); across micro-batches arrival order applies,
as in the reference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes as M
from ..sources.schema import Tables
from ..sources.buckets import change_buckets, published_unit, read_buckets
from ..sources.sinks import publish, read_manifest, read_published

_BASE = "request_id long, request_ts timestamp_ntz, actor_role string, actor_id long"
_PATCH = _BASE + ", id long, present array<string>"


@dataclass(frozen=True)
class StreamOp:
    apply: Callable[[DataFrame, Tables], M.Change]
    schema: str                       # request frame schema (DDL)
    insert_into: str | None = None    # relation the accepted rows append to


# Request frame schemas per operator (FIXTURES.md section 1).
OPS: dict[str, StreamOp] = {
    "admit_bookings": StreamOp(M.admit_bookings, _BASE + ", session_id long, status string", "booking"),
    "admit_reviews": StreamOp(M.admit_reviews, _BASE + ", session_id long, rating_score double, comment string",
                              "reviews"),
    "admit_progress": StreamOp(M.admit_progress, _BASE + ", booking_id long, activity string, duration string, "
                                                          "note string", "progress"),
    "admit_sessions": StreamOp(M.admit_sessions, _BASE + ", title string, deskripsi string, trainer_id long, "
                               "start_time timestamp_ntz, end_time timestamp_ntz, price decimal(10,2), status string",
                               "session"),
    "register_customers": StreamOp(M.register_customers, "request_id long, request_ts timestamp_ntz, nama string, "
                                   "email string, has_password boolean, propinsi string, kota string", "users"),
    "register_trainers": StreamOp(M.register_trainers, "request_id long, request_ts timestamp_ntz, nama string, "
                                  "email string, has_password boolean, propinsi string, kota string, "
                                  "spesialisasi string", "trainer"),
    "register_admins": StreamOp(M.register_admins, _BASE + ", nama string, email string, has_password boolean",
                                "admin"),
    "change_booking_status": StreamOp(M.change_booking_status, _BASE + ", booking_id long, status string"),
    "patch_sessions": StreamOp(M.patch_sessions, _PATCH + ", title string, deskripsi string, trainer_id long, "
                               "start_time timestamp_ntz, end_time timestamp_ntz, price decimal(10,2), status string"),
    "patch_progress": StreamOp(M.patch_progress, _PATCH + ", activity string, duration string, note string"),
    "patch_reviews": StreamOp(M.patch_reviews, _PATCH + ", rating_score double, comment string"),
    "delete_sessions": StreamOp(M.delete_sessions, _BASE + ", id long"),
    "delete_progress": StreamOp(M.delete_progress, _BASE + ", id long"),
    "delete_reviews": StreamOp(M.delete_reviews, _BASE + ", id long"),
    "delete_users": StreamOp(M.delete_users, _BASE + ", id long"),
    "merge_user_profiles": StreamOp(M.merge_user_profiles, _BASE + ", id long, nama string, email string, "
                                    "propinsi string, kota string"),
    "merge_trainer_profiles": StreamOp(M.merge_trainer_profiles, _BASE + ", id long, nama string, email string, "
                                       "spesialisasi string, propinsi string, kota string"),
}
REQUEST_SCHEMA = OPS["admit_bookings"].schema


def change_batch(spark: SparkSession, op: str, store: str, rejected_dir: str, source: str, buckets: bool = False):
    spec = OPS[op]

    def apply_to_buckets(batch: DataFrame, epoch_id: int) -> None:
        if epoch_id <= published_unit(spark, store, source):
            return
        change = spec.apply(batch, read_buckets(spark, store))
        change.rejected.write.mode("overwrite").parquet(f"{rejected_dir}/epoch={epoch_id}")
        change_buckets(spark, store, change.deltas, writer=source, unit=epoch_id)

    def apply(batch: DataFrame, epoch_id: int) -> None:
        now = read_manifest(spark, store)
        if now is not None and epoch_id <= now.writers.get(source, -1):
            return  # a replay: the epoch and its rejections are published
        change = spec.apply(batch, read_published(spark, store))
        # Before the version: if the job ends in between, the replay sees the
        # same state and writes the same rejections again.
        change.rejected.write.mode("overwrite").parquet(f"{rejected_dir}/epoch={epoch_id}")
        if spec.insert_into:
            publish(spark, store, added={spec.insert_into: change.accepted}, writer=source, unit=epoch_id)
        else:
            publish(spark, store, changed=change.states, writer=source, unit=epoch_id)
    return apply_to_buckets if buckets else apply


def start_change_stream(spark: SparkSession, op: str, request_dir: str, store: str, rejected_dir: str,
                        checkpoint: str, max_files_per_trigger: int | None = None,
                        available_now: bool = True, buckets: bool = False) -> StreamingQuery:
    """Apply the change operator ``op`` to request files arriving under
    ``request_dir``; rejected requests go to ``rejected_dir/epoch=<n>``. The
    streaming checkpoint location names the writer in the manifest. ``buckets``:
    ``store`` is one of id buckets."""
    reader = spark.readStream.schema(OPS[op].schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    apply = change_batch(spark, op, store, rejected_dir, source=f"{op}@{checkpoint}", buckets=buckets)
    writer = (reader.parquet(request_dir).writeStream.foreachBatch(apply)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_admission(spark: SparkSession, request_dir: str, store: str, rejected_dir: str, checkpoint: str,
                    max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Booking admission (M8) on a request stream."""
    return start_change_stream(spark, "admit_bookings", request_dir, store, rejected_dir, checkpoint,
                               max_files_per_trigger, available_now)
