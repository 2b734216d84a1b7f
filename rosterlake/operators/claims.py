"""Claims on unique keys in request order, settled for a whole batch.

Each claim moves a row to a key, and is granted if no other row holds the key
at that moment. Whether it does hangs on earlier claims: the holder may have
left (its own claim was granted) or another row may have come. A replay of the
batch would settle one claim after the other. Here a round settles all that
follow from what is known:

* a row's claim on the key it holds is granted;
* a key's holder keeps it at least until that row's first open claim on another
  key: claims of others before that are refused, however many;
* the first claim after that is granted if the holder's claim is. Such claims
  form chains (a wants b's key, b wants c's, ...). A chain that begins at a free
  key is granted, and found by pointer jumping in as many joins as its length
  has binary digits. A refusal goes down a chain as long as the holder has no
  further claim before the next one of the chain.

Then granted rows move, and the next round begins. The earliest open claim is
settled in each round, so the rounds end; batches in which keys change hands
once need two or three. Every table of a round is as large as the batch at
most; a hot key is one row a task before it is shuffled, and joins that may
meet one are exchanged on both sides, so adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import write_once
from .ids import dense_positions

C = F.col


def _split_key(name: str, *cols: str) -> Column:
    """Always 0, unknown to the planner: both inputs of the join called
    ``name`` are exchanged for it."""
    return F.pmod(F.xxhash64(*cols, F.lit(name)), F.lit(1)).alias("__apart")


def _on(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Left join on ``key``; ``right`` has one row a key."""
    a = left.withColumn("__apart", _split_key(name, key))
    return a.join(right.withColumn("__apart", _split_key(name, key)), [key, "__apart"], "left").drop("__apart")


def _jump(nodes: DataFrame) -> DataFrame:
    """``nodes(pos, parent, only, granted)`` with ``granted`` known wherever it
    follows from a chain of parents. ``only``: refused if the parent is."""
    while not nodes.where("granted is null and parent is not null").isEmpty():
        up = nodes.select(C("pos").alias("parent"), C("parent").alias("p_parent"), C("only").alias("p_only"), C("granted").alias("p_granted"))
        j = nodes.where("granted is null and parent is not null").join(up, "parent", "left")
        through = C("p_granted").isNull()
        stepped = j.select(
            "pos", F.when(through, C("p_parent")).alias("parent"), F.when(through, C("only") & C("p_only")).otherwise(C("only")).alias("only"),
            F.when(C("p_granted") | C("only"), C("p_granted")).alias("granted"))
        nodes = write_once(nodes.where("granted is not null or parent is null").unionByName(stepped))
    return nodes


def _round(open_: DataFrame, held: DataFrame) -> DataFrame:
    """The claims of ``open_(pos, row, key)`` that this round settles: (pos,
    row, key, granted). ``held(row, key)``: where each row is now."""
    now = held.select("row", C("key").alias("at"))
    # Written: the holders ask it twice more for each row's claims.
    claims = write_once(_on(open_, now, "row", "at"))
    leaving = claims.where(~C("key").eqNullSafe(C("at")))
    first = leaving.groupBy("row").agg(F.min("pos").alias("first"))
    claims = _on(claims, first, "row", "first")
    # The holder's open claims: its first on another key, and the next of all.
    second = claims.where(C("pos") > C("first")).groupBy("row").agg(F.min("pos").alias("second"))
    holders = (held.join(open_.select("key").distinct(), "key", "left_semi").select(C("key"), C("row").alias("holder"))
               .join(first.select(C("row").alias("holder"), C("first").alias("leaves")), "holder", "left")
               .join(second.select(C("row").alias("holder"), C("second").alias("again")), "holder", "left"))
    claims = write_once(_on(claims, holders, "key", "holder"))
    stays = C("at").eqNullSafe(C("key")) & (C("first").isNull() | (C("pos") < C("first")))
    refused = C("holder").isNotNull() & (C("holder") != C("row")) & (C("leaves").isNull() | (C("pos") < C("leaves")))
    told = claims.select("pos", "row", "key", "first", "holder", "leaves", "again",
                         F.when(F.coalesce(stays, F.lit(False)), True).when(F.coalesce(refused, F.lit(False)), False).alias("granted"))
    # The first claim on a key that is free, or after its holder may have left.
    best = told.where("granted is null").groupBy("key").agg(F.min("pos").alias("pos"))
    heads = told.join(best.select("pos"), "pos", "left_semi").where(C("pos") == C("first"))
    nodes = heads.select("pos", C("leaves").alias("parent"), (C("again").isNull() | (C("again") > C("pos"))).alias("only"),
                         F.when(C("holder").isNull(), True).alias("granted"))
    known = told.where("granted is not null").select("pos", F.lit(None).cast("long").alias("parent"), F.lit(True).alias("only"), "granted")
    settled = _jump(write_once(nodes.unionByName(known))).where("granted is not null").select("pos", "granted")
    return told.drop("granted").join(settled, "pos").select("pos", "row", "key", "granted")


def settle_claims(claims: DataFrame, holders: DataFrame, order: list[Column], request: str = "request_id") -> DataFrame:
    """(request, granted) for ``claims(request, ..., row, key)`` in ``order``,
    a total one, where ``holders(row, key)`` says which row holds which key
    before. A row of several keys counts with the least; a key that several
    rows hold before is refused to all."""
    told = dense_positions(claims, order, name="pos")
    held = holders.where(C("key").isNotNull() & C("row").isNotNull())
    wanted = told.select("key").distinct()
    ends = held.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("top"))
    shared = write_once(ends.where("low <> top").select("key"))
    held = (held.join(told.select("row").distinct(), "row", "left_semi").unionByName(held.join(wanted, "key", "left_semi"))
            .groupBy("row").agg(F.min("key").alias("key")))
    told = told.select("pos", C(request).alias("request"), "row", "key")
    lost = told.join(shared, "key", "left_semi").select("pos", F.lit(False).alias("granted"))
    open_ = write_once(told.join(shared, "key", "left_anti").select("pos", "row", "key"))
    # A shared key is nobody's: its rows can leave it, none can come.
    held = write_once(held.join(shared.withColumn("shared", F.lit(True)), "key", "left")
                       .select("row", F.when(C("shared"), F.lit(None)).otherwise(C("key")).alias("key")))
    out = lost
    while not open_.isEmpty():
        settled = write_once(_round(open_, held))
        moved = settled.where("granted").groupBy("row").agg(F.max(F.struct("pos", "key")).alias("to")).select("row", C("to.key").alias("to"))
        held = write_once(held.join(moved, "row", "outer").select("row", F.coalesce("to", "key").alias("key")))
        open_ = write_once(open_.join(settled.select("pos"), "pos", "left_anti"))
        out = out.unionByName(settled.select("pos", "granted"))
    return told.join(out, "pos").select(C("request").alias(request), "granted")
