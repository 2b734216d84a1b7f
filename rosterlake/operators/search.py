"""Search with paging and totals.

The filtered frame is built once and shared by the page (P1/P2) and the
total (P3), so both always use the same predicate. A page is
``orderBy().offset().limit()``, which Spark plans as a per-partition top-N
(TakeOrderedAndProject), never a full sort. ``paginate`` numbers every page
in one job for callers who want all pages (M1 technique, no global window).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.collation import sort_weight
from ..functions.columns import contains_like, parse_int
from .ids import dense_positions

C = F.col

# Sort allow-list and paging defaults of the user search.
USER_SORTABLE = ("id", "nama", "email", "created_at")
DEFAULT_PAGE, DEFAULT_LIMIT = 1, 20
USER_COLUMNS = ("id", "nama", "email", "propinsi", "kota", "created_at")
TRAINER_COLUMNS = ("id", "nama", "email", "specialization", "propinsi", "kota")


@dataclass(frozen=True)
class Page:
    rows: DataFrame      # the requested page
    total: DataFrame     # one row: total matches before paging
    page: int
    limit: int


def matching(df: DataFrame, **terms: str | None) -> DataFrame:
    """``AND``-ed ``LIKE '%term%'`` filters; a blank or missing term adds no
    filter (JS ``if (nama)``)."""
    for column, term in terms.items():
        if term:
            df = df.filter(contains_like(column, term))
    return df


def search_total(filtered: DataFrame) -> DataFrame:
    """COUNT(*) of the filtered frame; one row, 0 on no match."""
    return filtered.agg(F.count(F.lit(1)).alias("total"))


def sort_key(df: DataFrame, field: str) -> Column:
    """Collation-aware sort key: strings compare by their weights."""
    return sort_weight(field) if isinstance(df.schema[field].dataType, T.StringType) else C(field)


def page_args(page, limit) -> tuple[int, int]:
    return parse_int(page, DEFAULT_PAGE), parse_int(limit, DEFAULT_LIMIT)


def _page(filtered: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    return filtered.orderBy(*order).offset((page - 1) * limit).limit(limit)


def search_users(users: DataFrame, nama: str | None = None, email: str | None = None, sort: str | None = "id",
                 order: str | None = "ASC", page=1, limit=20) -> Page:
    """Optional name and email terms; sort field from the allow-list
    (else id); DESC only for exactly ``'DESC'``; ties broken by id."""
    pg, lim = page_args(page, limit)
    field = sort if sort in USER_SORTABLE else "id"
    filtered = matching(users.select(*USER_COLUMNS), nama=nama, email=email)
    key = sort_key(filtered, field)
    desc = order == "DESC"
    primary = key.desc_nulls_last() if desc else key.asc_nulls_first()
    tiebreak = [] if field == "id" else [C("id").asc()]
    return Page(rows=_page(filtered, [primary, *tiebreak], pg, lim), total=search_total(filtered),
                page=pg, limit=lim)


def search_trainers(trainer: DataFrame, nama: str | None = None, email: str | None = None, page=1,
                    limit=20) -> Page:
    """Name term only (the email term is accepted and ignored, as in the
    reference); ``spesialisasi`` exposed as ``specialization``; the reference
    has no ORDER BY, so pages are ordered by id to be stable."""
    del email  # parsed but unused by the reference handler
    pg, lim = page_args(page, limit)
    base = trainer.select("id", "nama", "email", C("spesialisasi").alias("specialization"), "propinsi", "kota")
    filtered = matching(base, nama=nama)
    return Page(rows=_page(filtered, [C("id").asc()], pg, lim), total=search_total(filtered), page=pg, limit=lim)


def paginate(df: DataFrame, order: list[Column], limit=20) -> DataFrame:
    """Every row with ``row_no`` (1-based, in ``order``) and ``page_no``
    under the same page maths as P1/P2."""
    _, lim = page_args(1, limit)
    pos = dense_positions(df, order, name="row_no")
    return pos.withColumn("page_no", F.floor((C("row_no") - 1) / F.lit(lim)).cast("bigint") + 1)
