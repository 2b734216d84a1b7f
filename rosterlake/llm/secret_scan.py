"""Secret scan with multipart credential linking, in DataFrame functions only.

Base findings are the leftmost non-overlapping matches of three patterns. Their
places come from splitting the text at the pattern: a match starts after the
pieces and matches before it.

Linking: access identifiers, weak secrets (long mixed tokens without a keyword)
and endpoints are parts of credentials. A weak secret alone is too common to
report. Parts are dealt to scopes, blocks of ``SCOPE`` code points, and
interval-joined on (document, scope): a weak secret is reported only where an
access identifier and an endpoint, or an access identifier next to it, lie
within ``SCOPE`` code points. A weak secret goes to every scope that it reaches,
``SCOPE`` code points before its start to as many after its end, another part to
every scope that it covers, so parts within reach always share one. A scope
holds at most as many parts as fit in its characters and its neighbours', so no
group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import Scratch

SCOPE = 400
NEXT_TO = 120

# The contract's patterns. hex and access need their full length
# from the start: a run that is too short fails as a whole.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
MIN_VALUE = 6

# Parts that are no finding by themselves.
WEAK_SECRET = r"[A-Za-z0-9+/_-]{32,}={0,2}"
WEAK_ACCESS = r"(?:ASIA|AIDA|AROA)[A-Z0-9]{16,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"


EMPTY = "cast(array() as array<struct<kind:string,start:long,end:long,value:int>>)"
#: Array elements folded at a time; a longer array is folded by runs of them.
RUN = 256
#: Code points in a block of a text that is cut at many places.
BLOCK = 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs that isn't empty, the fold of all
    before it, from 0. An array grows by copying, so runs of ``RUN`` elements
    are folded each for itself and then moved by the fold of the runs before."""
    def fold(items: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<long>)").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(
            step(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def moved(runs: Column) -> Column:
        return _let(fold(runs, lambda r: r["at"])["out"], lambda bases: F.flatten(F.zip_with(
            runs, bases, lambda run, base: F.transform(run["out"], lambda x: step(base, x)))))

    def whole(v: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        return _let(F.transform(number, lambda k: fold(F.slice(v, k * RUN + 1, RUN), lambda x: x)), moved)

    return _let(values, whole)


def _with_spans(df: DataFrame, text: str, out: str, kind: str, pattern: str, value_group: int = 0) -> DataFrame:
    """``df`` with an array ``out`` of (kind, start, end, value) for every
    match, in code points; ``value`` is the length of the group's text."""
    df = df.withColumn("__m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    some = F.size("__m") > 0
    value = F.col("__m") if not value_group else F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(value_group))
    df = df.withColumn("__v", F.when(some, value)).withColumn("__g", F.when(some, F.split(F.col(text), pattern, -1)))
    steps = F.zip_with(F.slice("__g", 1, F.size("__m")), F.arrays_zip(F.col("__m").alias("m"), F.col("__v").alias("v")),
                       lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m["m"]).alias("n"), F.char_length(m["v"]).alias("v")))

    def placed(steps: Column) -> Column:
        at = _before(F.transform(steps, lambda s: (s["gap"] + s["n"]).cast("long")), lambda a, b: a + b)
        return F.zip_with(steps, at, lambda s, a: F.struct(
            F.lit(kind).alias("kind"), (a + s["gap"]).alias("start"), (a + s["gap"] + s["n"]).alias("end"), s["v"].cast("int").alias("value")))

    spans = F.when(some, _let(steps, placed)).otherwise(F.expr(EMPTY))
    if value_group:
        spans = F.filter(spans, lambda s: s["value"] >= MIN_VALUE)
    return df.withColumn(out, spans).drop("__m", "__v", "__g")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(rank, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with arrays ``found`` (kind, start, end) and ``parts`` (role,
    start, end) of what may be parts of a credential."""
    full = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    for kind, pattern in BASE:
        full = _with_spans(full, "__text", f"__{kind}", kind, pattern, 2 if kind == "assign" else 0)
    for role, pattern in (("secret", WEAK_SECRET), ("id", WEAK_ACCESS), ("endpoint", ENDPOINT)):
        full = _with_spans(full, "__text", f"__{role}", role, pattern)
    full = full.withColumn("found", _ordered(F.concat("__assign", "__access", "__hex")))
    ids = F.transform("__access", lambda s: F.struct(F.lit("id").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    # A weak secret inside a finding is no new span.
    free = F.filter("__secret", lambda w: ~F.exists("found", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    parts = F.when(F.size("__secret") > 0, F.concat(free, ids, F.col("__id"), F.col("__endpoint")))
    return full.withColumn("parts", parts).drop("__text", *[f"__{k}" for k in ("assign", "access", "hex", "secret", "id", "endpoint")])


def linked_candidates(parts: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of weak secrets with complementary parts in scope,
    from a table (key, kind, start, end)."""
    def scopes(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / SCOPE), F.floor(end / SCOPE))).alias("scope")

    s, e = F.col("start"), F.col("end")
    secrets = parts.where("kind = 'secret'").select(key, s.alias("s"), e.alias("e"), scopes(s - SCOPE, e + SCOPE))
    others = parts.where("kind <> 'secret'").select(key, "kind", s.alias("os"), e.alias("oe"), scopes(s, e))
    # Pairs that share several scopes meet again; the aggregates don't mind.
    gap = F.greatest(F.lit(0), F.col("os") - F.col("e"), F.col("s") - F.col("oe"))
    near = secrets.join(others, [key, "scope"]).withColumn("gap", gap).where(F.col("gap") <= SCOPE)
    is_id = F.col("kind") == "id"
    return (near.groupBy(key, "s", "e").agg(F.max(is_id).alias("id"), F.max(~is_id).alias("endpoint"), F.min(F.when(is_id, F.col("gap"))).alias("gap"))
            .where("id and endpoint or gap <= %d" % NEXT_TO).select(key, F.col("s").alias("start"), F.col("e").alias("end")))


def scan(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``found`` (base findings) and ``spans`` (those and the
    linked weak candidates), each (kind, start, end) in code points.

    A null text is empty and has none. Repeated rows are scanned each for
    itself: a written row number joins the parts, not the id. Other columns
    stay whatever they are called; those named ``found`` or ``spans`` are
    replaced. Without ``keep_text`` the text is left out and not written.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    held = [c for c in docs.columns if c not in ("found", "spans") and (keep_text or c != text_col)]
    # Columns of the caller are fields of one struct, under numbers.
    doc = F.struct(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(held)])
    first = scratch.table(base_findings(docs.select(doc.alias("doc"), F.col(f"`{text_col}`").alias("text"))).drop("text"), "findings")
    parts = first.where("size(parts) > 0").select("doc.row", F.explode("parts").alias("p")).select("row", "p.kind", "p.start", "p.end")
    weak = linked_candidates(parts, "row").groupBy("row").agg(F.collect_list(F.struct(F.lit("weak").alias("kind"), "start", "end")).alias("weak"))
    weak = scratch.table(weak, "weak")
    both = first.join(weak, first["doc.row"] == weak["row"], "left")
    spans = F.when(F.col("weak").isNull(), F.col("found")).otherwise(_ordered(F.concat("found", F.coalesce("weak", F.col("found")))))
    return both.select(*[F.col(f"doc.c{k}").alias(c) for k, c in enumerate(held)], "found", spans.alias("spans"))


def mask(text: str, spans: str, cover: str = "[REDACTED]") -> Column:
    """The text with every span (united where they overlap) replaced."""
    def piece(blocks: Column, start: Column, end: Column) -> Column:
        # A substring counts from the start of its text, so it is taken of the blocks it lies in.
        first = F.floor(start / BLOCK).cast("int")
        own = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return own.substr((start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))

    def covered(e: Column) -> Column:
        # ``at`` is where the spans before end; a span that starts earlier lies in what is covered.
        out = F.zip_with(F.col(spans), e["at"], lambda s, at: F.when(
            s["start"] >= at, F.concat(piece(e["blocks"], at, s["start"]), F.lit(cover))).otherwise(""))
        last = F.greatest(F.element_at(e["at"], -1), F.element_at(F.col(spans), -1)["end"])
        return F.concat(F.array_join(out, ""), piece(e["blocks"], last, e["length"]))

    blocks = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    at = _before(F.transform(F.col(spans), lambda s: s["end"]), F.greatest)
    env = F.struct(blocks.alias("blocks"), at.alias("at"), F.char_length(F.col(text)).cast("long").alias("length"))
    return F.when(F.size(spans) > 0, _let(env, covered)).otherwise(F.col(text))
