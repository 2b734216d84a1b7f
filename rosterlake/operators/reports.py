"""Relational reports: the seven views and the report handlers (J1-J14) plus
the plain listings (S3-S6).

Shape rules used throughout:

* Per-session counts are aggregated from ``booking`` by ``session_id`` before
  the join (partial aggregation runs map-side, so a hot session costs one
  partial row per task, and only ``(session_id, n)`` pairs are shuffled). The
  left join then keeps sessions without bookings, and ``coalesce(n, 0)``
  restores the zero that ``COUNT(b.id)`` over a left join gives.
* Member / trainer restrictions are left-semi joins applied to the fact table
  before the dimension joins.
* Sorting happens only at the edge (``ordered=True``), never inside a frame
  another operator reuses.
* No broadcast hints on data-sized dimensions: AQE converts a join to a
  broadcast only when the measured side is under
  ``spark.sql.autoBroadcastJoinThreshold``, and sort-merge joins otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import Tables

C = F.col


def _trainer_names(t: Tables) -> DataFrame:
    return t.trainer.select(C("id").alias("tr_id"), C("nama").alias("trainer_name"),
                            C("email").alias("trainer_email"))


def _customers(t: Tables) -> DataFrame:
    return t.users.select(C("id").alias("cu_id"), C("nama").alias("customer_name"),
                          C("email").alias("customer_email"))


def _sessions_with_trainer(t: Tables, session: DataFrame | None = None) -> DataFrame:
    s = t.session if session is None else session
    return s.join(_trainer_names(t), C("trainer_id") == C("tr_id"))


def restrict(df: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    """Left-semi restriction of ``df`` to the ids in the first column of
    ``keys`` (None = no restriction). Semi joins never fan out."""
    if keys is None:
        return df
    k = keys.select(C(keys.columns[0]).alias("__k"))
    return df.join(k, C(key) == C("__k"), "left_semi")


def _edge(df: DataFrame, ordered: bool, *order: Column) -> DataFrame:
    return df.orderBy(*order) if ordered else df


def booking_counts(booking: DataFrame, **counts: Column) -> DataFrame:
    """Per-session counts of bookings, e.g.
    ``booking_counts(b, n=F.count_if(C('status') == 'Confirmed'))``."""
    return booking.groupBy(C("session_id").alias("bc_session_id")).agg(
        *[expr.alias(name) for name, expr in counts.items()])


def _with_counts(sessions: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    joined = sessions.join(counts, C("id") == C("bc_session_id"), "left")
    return joined.select(*[c for c in sessions.columns],
                         *[F.coalesce(C(n), F.lit(0).cast("bigint")).alias(n) for n in names])


def _confirmed(booking: DataFrame) -> DataFrame:
    return booking.filter(C("status") == "Confirmed")


# ---------------------------------------------------------------- J7, J10-J13

def session_participant_counts(t: Tables) -> DataFrame:
    """Every session with its trainer and the number of Confirmed
    bookings; sessions with none keep a 0. All dates and statuses."""
    counts = booking_counts(_confirmed(t.booking), confirmed_participants=F.count("id"))
    s = _sessions_with_trainer(t).select("id", "title", "start_time", "end_time", "price", "trainer_name")
    return _with_counts(s, counts, ["confirmed_participants"]).withColumnRenamed("id", "session_id")


def session_participant_counts_literal(t: Tables) -> DataFrame:
    """J7 in the view's literal form (join, then group); kept to check the
    pre-aggregated plan against it."""
    b = _confirmed(t.booking).select(C("id").alias("b_id"), C("session_id").alias("b_session_id"))
    j = _sessions_with_trainer(t).join(b, C("b_session_id") == C("id"), "left")
    return (j.groupBy(C("id").alias("session_id"), "title", "start_time", "end_time", "price", "trainer_name")
            .agg(F.count("b_id").alias("confirmed_participants")))


def upcoming_sessions(t: Tables, as_of: Column) -> DataFrame:
    """J12 (v1 view): sessions starting strictly after ``as_of``, any session
    status (cancelled included), with the Confirmed count."""
    s = _sessions_with_trainer(t, t.session.filter(C("start_time") > as_of))
    counts = booking_counts(_confirmed(t.booking), confirmed_bookings=F.count("id"))
    s = s.select("id", "title", "deskripsi", "start_time", "end_time", "price", "trainer_name")
    return _with_counts(s, counts, ["confirmed_bookings"]).withColumnRenamed("id", "session_id")


def upcoming_sessions_member_view(t: Tables, as_of: Column) -> DataFrame:
    """J13 (v2 shape): adds trainer_id and ``total_bookings`` (all statuses)
    next to the Confirmed count; one aggregate gives both counts."""
    s = _sessions_with_trainer(t, t.session.filter(C("start_time") > as_of)).select(
        "id", "title", "trainer_id", "trainer_name", "start_time", "end_time", "price")
    counts = booking_counts(t.booking, confirmed_customers=F.count_if(C("status") == "Confirmed"),
                            total_bookings=F.count("id"))
    return _with_counts(s, counts, ["confirmed_customers", "total_bookings"])


def trainer_schedule(t: Tables, as_of: Column, trainers: DataFrame | None = None,
                     ordered: bool = True) -> DataFrame:
    """J10 (v1 view): upcoming sessions per trainer with the Confirmed count,
    ordered by trainer name then start time."""
    sess = restrict(t.session.filter(C("start_time") > as_of), "trainer_id", trainers)
    s = _sessions_with_trainer(t, sess).select(
        C("trainer_id"), "trainer_name", "id", "title", "start_time", "end_time")
    counts = booking_counts(_confirmed(t.booking), confirmed_customers=F.count("id"))
    out = _with_counts(s, counts, ["confirmed_customers"]).withColumnRenamed("id", "session_id")
    return _edge(out, ordered, C("trainer_name").asc(), C("start_time").asc())


def trainer_sessions(t: Tables, trainers: DataFrame | None = None) -> DataFrame:
    """J11 (what the v2 endpoint returns): every column of the trainer's
    sessions, all dates, plus the number of bookings whose status is *not*
    Confirmed. The reference names that count ``confirmed_customers``; the
    name is kept for fidelity although it counts the opposite."""
    sess = restrict(t.session, "trainer_id", trainers)
    counts = booking_counts(t.booking.filter(C("status") != "Confirmed"), confirmed_customers=F.count("id"))
    return _with_counts(sess, counts, ["confirmed_customers"])


# ------------------------------------------------------------ J1-J6, J8, J9, J14

def _history(t: Tables, members: DataFrame | None) -> DataFrame:
    b = restrict(t.booking, "member_id", members)
    s = _sessions_with_trainer(t).select(C("id").alias("s_id"), C("title").alias("session_title"),
                                         "start_time", "end_time", "trainer_name")
    return (b.join(s, C("session_id") == C("s_id"))
            .join(_customers(t), C("member_id") == C("cu_id"))
            .select(C("cu_id").alias("customer_id"), "customer_name", C("id").alias("booking_id"),
                    "session_title", "start_time", "end_time", "trainer_name", "status",
                    C("datetime_created").alias("booked_on")))


def customer_booking_history(t: Tables, ordered: bool = True) -> DataFrame:
    """Booking x session x customer x trainer, ordered by customer then
    newest class first."""
    return _edge(_history(t, None), ordered, C("customer_id").asc(), C("start_time").desc())


def customer_booking_history_for(t: Tables, members: DataFrame, ordered: bool = True) -> DataFrame:
    """J1 for the given customers; the restriction is a semi join on
    ``booking`` below every other join."""
    return _edge(_history(t, members), ordered, C("customer_id").asc(), C("start_time").desc())


def matched_trainer_customer(t: Tables) -> DataFrame:
    """Confirmed bookings with both parties' names and emails. The view's
    booking_id is kept so repeated (session, customer) pairs stay distinct."""
    s = _sessions_with_trainer(t).select(C("id").alias("s_id"), C("title").alias("session_title"),
                                         "start_time", C("tr_id").alias("trainer_id"), "trainer_name",
                                         "trainer_email")
    return (_confirmed(t.booking).join(s, C("session_id") == C("s_id"))
            .join(_customers(t), C("member_id") == C("cu_id"))
            .select(C("id").alias("booking_id"), C("s_id").alias("session_id"), "session_title", "start_time",
                    "trainer_id", "trainer_name", "trainer_email", C("cu_id").alias("customer_id"),
                    "customer_name", "customer_email", "status", "datetime_created"))


def _progress_summary(t: Tables, members: DataFrame | None) -> DataFrame:
    p = restrict(t.progress, "member_id", members)
    return (p.join(_customers(t), C("member_id") == C("cu_id"))
            .select(C("id").alias("progress_id"), C("cu_id").alias("member_id"),
                    C("customer_name").alias("member_name"), "activity", "duration", "note",
                    C("jam_nyatat").alias("recorded_at")))


def member_progress_summary(t: Tables, ordered: bool = True) -> DataFrame:
    """Progress of customers with their names, newest first."""
    return _edge(_progress_summary(t, None), ordered, C("recorded_at").desc())


def member_progress_summary_for(t: Tables, members: DataFrame, ordered: bool = True) -> DataFrame:
    """J4 for the given customers."""
    return _edge(_progress_summary(t, members), ordered, C("recorded_at").desc())


def my_progress(t: Tables, members: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Five progress columns straight from ``progress`` (no role check),
    newest first; ``member_id`` is carried for the batch form."""
    p = restrict(t.progress, "member_id", members).select(
        "member_id", C("id").alias("progress_id"), "activity", "duration", "note",
        C("jam_nyatat").alias("recorded_at"))
    return _edge(p, ordered, C("member_id").asc(), C("recorded_at").desc())


def session_roster(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """One row per booking (any status) with customer and session; the
    optional session restriction is a semi join on ``booking``."""
    b = restrict(t.booking, "session_id", sessions)
    s = t.session.select(C("id").alias("s_id"), C("title").alias("session_title"), "trainer_id")
    return (b.join(s, C("session_id") == C("s_id"))
            .join(_customers(t), C("member_id") == C("cu_id"))
            .select(C("id").alias("booking_id"), "status", C("member_id").alias("customer_id"),
                    "customer_name", C("s_id").alias("session_id"), "session_title", "trainer_id"))


def _reviews_joined(t: Tables, sessions: DataFrame | None) -> DataFrame:
    r = restrict(t.reviews, "session_id", sessions)
    s = _sessions_with_trainer(t).select(C("id").alias("s_id"), C("title").alias("session_title"),
                                         "trainer_name")
    return (r.join(s, C("session_id") == C("s_id"))
            .join(_customers(t), C("member_id") == C("cu_id")))


def session_reviews_summary(t: Tables, sessions: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Reviews with session title, trainer and customer names, newest
    review id first."""
    out = _reviews_joined(t, sessions).select(
        C("id").alias("review_id"), C("s_id").alias("session_id"), "session_title", "trainer_name",
        "customer_name", "rating_score", "comment")
    return _edge(out, ordered, C("review_id").desc())


def session_reviews(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """J9, six-column variant of the public reviews-by-session endpoint."""
    return _reviews_joined(t, sessions).select(
        C("s_id").alias("session_id"), "session_title", "rating_score", "trainer_name", "customer_name",
        "comment")


def my_bookings(t: Tables, members: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """A member's bookings with class title, start and trainer name,
    newest class first; ``member_id`` is carried for the batch form."""
    b = restrict(t.booking, "member_id", members)
    s = _sessions_with_trainer(t).select(C("id").alias("s_id"), "title", "start_time", "trainer_name")
    out = b.join(s, C("session_id") == C("s_id")).select(
        "member_id", C("id").alias("booking_id"), "status", "title", "start_time", "trainer_name")
    return _edge(out, ordered, C("member_id").asc(), C("start_time").desc())


# ----------------------------------------------------------------- S3-S6

def session_catalog(t: Tables) -> DataFrame:
    """S3: the eight public session columns (drops ``updated_at``)."""
    return t.session.select("id", "title", "deskripsi", "trainer_id", "start_time", "end_time", "price", "status")


def booking_list(t: Tables) -> DataFrame:
    """All bookings with the member's name. A stored ``member_name`` (v2)
    is returned as stored; rows without one (v1 data) take the customer's
    current name through a left join, so no booking is dropped."""
    u = t.users.select(C("id").alias("u_id"), C("nama").alias("u_nama"))
    return (t.booking.join(u, C("member_id") == C("u_id"), "left")
            .select("id", "session_id", "member_id", "status", "datetime_created",
                    F.coalesce(C("member_name"), C("u_nama")).alias("member_name")))


def progress_list(t: Tables) -> DataFrame:
    """S5."""
    return t.progress.select("id", "member_id", "booking_id", "activity", "duration", "note", "jam_nyatat")


def review_list(t: Tables) -> DataFrame:
    """S6."""
    return t.reviews.select("id", "session_id", "member_id", "rating_score", "comment", "datetime_created")
