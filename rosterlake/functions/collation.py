"""The declared collation of the text columns, as Spark expressions.

``users``, ``trainer`` and ``admin`` are declared ``latin1`` with the Swedish
case-insensitive collation: case and most accents make no difference (e = É),
å, ä and ö are letters of their own after z, and ü is a y. Every character has
one weight; texts are equal if their weights are, trailing blanks aside.

``weights`` maps characters to weights with ``translate``, so joins, groups,
uniqueness checks, sorts and LIKE work on plain strings inside whole-stage
codegen. Characters that the charset lacks can't be in such a column; where a
frame holds them, they differ from all others (case folds in ``norm_key``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with the weight of another one. The Swedish letters
# weigh what stands at their place in the national 7-bit code.
WEIGHTS = {
    "A": "ÀÁÂÃàáâã",
    "C": "Çç",
    "D": "Ðð",
    "E": "ÈÉÊËèéêë",
    "I": "ÌÍÎÏìíîï",
    "N": "Ññ",
    "O": "ÒÓÔÕòóôõ",
    "U": "ÙÚÛùúû",
    "Y": "ÜÝüý",
    "[": "Åå",
    "\\": "ÄÆäæ",
    "]": "Öö",
    "Ø": "ø",
    "Þ": "þ",
}


def _table() -> dict[str, str]:
    """Character -> weight, where they differ. Weights order like code points."""
    table = {c: w for w, chars in WEIGHTS.items() for c in chars}
    table |= {chr(c): chr(c - 32) for c in range(ord("a"), ord("z") + 1)}
    # The charset's places 80 to 9F hold typographic characters: they weigh
    # their place.
    table |= {bytes([b]).decode("cp1252", "ignore"): chr(b) for b in range(0x80, 0xA0)}
    table.pop("", None)
    return table


_WEIGHT = _table()
_FROM, _TO = "".join(_WEIGHT), "".join(_WEIGHT.values())
#: Stands for the weight ``\\`` in patterns, where that is the escape.
_BACKSLASH = "\ue05c"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weights(c: str | Column) -> Column:
    """The text's weights, trailing blanks kept."""
    return F.translate(_col(c), _FROM, _TO)


def norm_key(c: str | Column) -> Column:
    """Equality key: two texts are equal under the collation if and only if
    their keys are. In lower case, so a plain text's key reads like itself."""
    return F.lower(F.rtrim(weights(c)))


def sort_weight(c: str | Column) -> Column:
    """What ORDER BY compares. (A control character after a text sorts behind
    it here, before it in the store, which pads with blanks.)"""
    return F.rtrim(weights(c))


def like_text(c: str | Column) -> Column:
    """What a ``like_pattern`` is compared with."""
    return F.translate(_col(c), _FROM + "\\", (_TO + "\\").replace("\\", _BACKSLASH))


def like_pattern(pattern: str) -> str:
    """A LIKE pattern in weights. ``%`` and ``_`` stay wildcards unless escaped
    by a backslash; a backslash before any other character stands for that
    character, a doubled one for itself."""
    def weigh(c: str) -> str:
        return _WEIGHT.get(c, c).replace("\\", _BACKSLASH)

    return re.sub(r"\\(.?)|(.)", lambda m: m[0] if m[1] in ("%", "_") else weigh(m[2] or m[1] or "\\"), pattern, flags=re.S)
