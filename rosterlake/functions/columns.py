"""Column helpers for the reference's scalar surface.

All of them build JVM-side expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collation import like_pattern, like_text


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: str | Column, numeric: bool = False) -> Column:
    """JS truthiness of a request field: missing, null and '' are false; with
    ``numeric`` a zero is false as well. Never null."""
    c = col(c)
    if numeric:
        # A number or a numeric string: 0 and '0'-like values are falsy only
        # when they are numbers; callers pass typed columns here.
        return F.coalesce(c.isNotNull() & (c != 0), F.lit(False))
    return F.coalesce(c.isNotNull() & (c.cast("string") != ""), F.lit(False))


def js_or(a: str | Column, b: str | Column) -> Column:
    """``a || b`` for strings: a blank or null ``a`` falls back on ``b``."""
    return F.coalesce(F.nullif(col(a), F.lit("")), col(b))


def contains_like(c: str | Column, term: str) -> Column:
    """``c LIKE '%term%'`` under the declared collation. The term is not
    escaped, so ``%`` and ``_`` inside it stay wildcards, as in the reference.
    A backslash that escapes neither of these nor itself stands for the
    character after it; one at the term's end escapes the closing ``%``."""
    return like_text(c).like(like_pattern(f"%{term}%"))


def first_failing(checks: Sequence[tuple[str, Column]]) -> Column:
    """Ordered validation: the reason of the first check whose condition is
    true, else NULL. Conditions that are NULL count as passing."""
    return F.coalesce(*[F.when(cond, F.lit(reason)) for reason, cond in checks], F.lit(None).cast("string"))


def parse_int(value, default: int) -> int:
    """``parseInt(x) || default`` on a driver-side argument: the leading digits
    count ('12abc' is 12, '3.7' is 3); without any, 0 and missing fall back on
    the default; a negative value is refused."""
    found = re.match(r"\s*([+-]?[0-9]+)", "" if value is None else str(value), re.ASCII)
    n = int(found[1]) if found else 0
    if n < 0:
        raise ValueError(f"negative paging argument: {value!r}")
    return n or default


def in_domain(c: str | Column, domain: Iterable[str]) -> Column:
    """Enum membership, case-sensitive like the JS checks; NULL is outside."""
    return F.coalesce(col(c).isin(*domain), F.lit(False))


def rating_value(c: str | Column) -> Column:
    """A stored rating: MariaDB rounds a fractional value on store into the
    TINYINT column (4.5 -> 5); Spark's cast would truncate, so round first."""
    return F.round(col(c).cast("double"), 0).cast(T.ByteType())
