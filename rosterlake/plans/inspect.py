"""Plan checks used by the tests: no cartesian product, no
Python UDF node, no window without a partition spec (a global window runs in
one task). A global aggregate's ``Exchange SinglePartition`` is allowed: it
carries one partial row per task, not the data."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def explain_text(df: DataFrame, mode: str = "extended") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
GLOBAL_WINDOW = re.compile(r"Window \[.*?\], \[\], \[")


def plan_violations(df: DataFrame) -> list[str]:
    text = explain_text(df, "simple")
    bad = [name for name in FORBIDDEN if name in text]
    if GLOBAL_WINDOW.search(text):
        bad.append("global Window")
    return bad
