"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one node. The first neighbour lists come from
sorting the nodes, label by label, by sign codes of random hyperplanes and
comparing each with its surroundings. A round of NN-descent then joins the
neighbours of each node, forward and reverse, among each other, so that
neighbours of neighbours meet, and keeps what improves a list.

A list holds the ``K`` best neighbours. Where all ``K`` pass the threshold it
is saturated and is enlarged, to at most ``WIDE`` neighbours that pass, so a
round's table grows with the nodes and not with the pairs of a cluster. A
passing neighbour never leaves a list. A pair that passes while a list is full
is not stored, but what it connects is: of the passing pairs of a leaf or of a
joined neighbourhood a spanning forest goes on (``bridge`` rows). A round takes
``JOINED`` members of a list in each direction, others every round, so a hub
costs no more than any node.

Rounds go on until the threshold edges grow by less than ``STILL``, or to
``ROUNDS``. What ``WIDE`` and ``JOINED`` leave out of saturated lists is then
counted exactly: a component with a saturated list is dealt into tiles, and all
its pairs are compared, tile by tile; only counts leave a tile. An audit follows
always, ``AUDITED`` nodes against all others by brute force. Under a recall of
``RECALL`` all pairs of the labels that missed links are compared in the same
way, which gives their links and components exactly, and other nodes are audited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import Scratch
from rosterlake.llm.components import connected_components

K = 10
WIDE = 32
JOINED = 12
TREES = 4
LEAF = 128
PLANES = 24
ROUNDS = 8
STILL = 0.002
AUDITED = 256
#: Above any cosine: the bound of a list that takes no more.
FULL = 9.0
RECALL = 0.985
TILE = 2048


def _unit(raw: pa.Array, kind: str) -> np.ndarray:
    """Unit rows, in double precision, of equally long binary vectors."""
    rows = np.frombuffer(b"".join(raw.to_pylist()), kind).astype(np.float64).reshape(len(raw), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return list(zip(first, np.append(first[1:], len(new)), strict=True))


Found = list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]


def _edges_batch(found: Found) -> pa.RecordBatch:
    """Edges once each; what is found as a candidate and as a bridge is both."""
    src, dst = (np.concatenate([x[i] for x in found] or [np.zeros(0)]).astype(np.int64) for i in range(2))
    sim = np.concatenate([x[2] for x in found] or [np.zeros(0)]).astype(np.float64)
    bridge = np.repeat(np.array([x[3] for x in found], bool), [len(x[0]) for x in found])
    order = np.lexsort((bridge, dst, src))
    src, dst, sim, bridge = src[order], dst[order], sim[order], bridge[order]
    first = np.ones(len(src), bool)
    first[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]) | (bridge[1:] != bridge[:-1])
    return pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (src, dst, sim, bridge)], ["src", "dst", "sim", "bridge"])


def _forest(hit: np.ndarray, first: int = 0) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric boolean matrix, grown from the
    row ``first``."""
    left, a, b = np.ones(len(hit), bool), [], []
    for root in (first, *range(len(hit))):
        stack = [root] if left[root] else []
        left[root] = False
        while stack:
            p = stack.pop()
            near = np.flatnonzero(hit[p] & left).tolist()
            left[near] = False
            a += [p] * len(near)
            b += near
            stack += near
    return a, b


EDGE = "src long, dst long, sim double, bridge boolean"


def _leaves(nodes: DataFrame, tree: int, kind: str, threshold: float) -> DataFrame:
    """Edges among neighbours in the order of one set of sign codes."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            size = np.array([len(v) for v in b.column(2).to_pylist()])
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                unit = _unit(b.column(2).take(pa.array(own)), kind)
                planes = np.random.default_rng(1000 * tree + 7).standard_normal((unit.shape[1], PLANES))
                out[own] = (unit @ planes > 0) @ (1 << np.arange(PLANES - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "code"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = np.asarray(b.column(0))
            found = []
            for i, j in _runs(np.asarray(b.column(1)), np.asarray(pc.binary_length(b.column(2)))):
                for p in range(i, j, LEAF // 2):
                    # Leaves overlap by half; the last one reaches back.
                    p, q = max(i, min(p, j - LEAF)), min(j, p + LEAF)
                    unit = _unit(b.column(2).slice(p, q - p), kind)
                    sim = unit @ unit.T
                    np.fill_diagonal(sim, -2)
                    k = min(K, q - p - 1)
                    if k > 0:
                        best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                        hit = sim >= threshold
                        # Up to WIDE that pass, those that follow a node first.
                        turned = (np.arange(q - p)[:, None] + np.arange(1, q - p)) % (q - p)
                        after = np.take_along_axis(hit, turned, axis=1)
                        keep = np.zeros_like(hit)
                        np.put_along_axis(keep, turned, after & (np.cumsum(after, axis=1) <= WIDE), axis=1)
                        np.put_along_axis(keep, best, True, axis=1)
                        a, c = np.nonzero(keep)
                        found.append((node[p:q][a], node[p:q][c], sim[a, c], False))
                        a, c = _forest(hit) if hit.any() else ([], [])
                        found.append((node[p:q][a], node[p:q][c], sim[a, c], True))
                    if q == j:
                        break
            yield _edges_batch(found)

    coded = nodes.select("node", "label", "vec").mapInArrow(code, "node long, label int, vec binary, code long")
    return (coded.repartitionByRange("label", "code", "node").sortWithinPartitions("label", F.octet_length("vec"), "code", "node")
            .select("node", "label", "vec").mapInArrow(near, EDGE))


def _best(edges: DataFrame, threshold: float) -> DataFrame:
    """Lists from candidate edges (src, dst, sim, old): the K best, and up to
    WIDE of those that pass; listed ones that pass stay."""
    one = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    passing = F.col("sim") >= threshold
    order = [F.desc("passing"), F.desc(F.col("passing") & F.col("old")), F.when(F.col("passing"), F.xxhash64("src", "dst")), F.desc("sim"), "dst"]
    ranked = one.withColumn("passing", passing).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(*order)))
    return ranked.where(F.col("rank") <= WIDE).where(F.col("passing") | (F.col("rank") <= K)).select("src", "dst", "sim")


def _descend(graph: DataFrame, nodes: DataFrame, turn: int, kind: str, threshold: float) -> DataFrame:
    """Candidate edges of one round: neighbours of neighbours that pass the
    threshold or beat the last of a list, none for a list that is full; and
    bridges, passing pairs that no list edge of their center connects."""
    def some(center: str, member: str) -> DataFrame:
        pick = F.row_number().over(Window.partitionBy(center).orderBy(F.xxhash64(center, member, F.lit(turn)), member))
        return (graph.withColumn("pick", pick).where(F.col("pick") <= JOINED)
                .select(F.col(center).alias("center"), F.col(member).alias("member")))

    itself = nodes.select(F.col("node").alias("center"), F.col("node").alias("member"))
    members = some("src", "dst").unionByName(some("dst", "src")).distinct().unionByName(itself)
    full = F.sum((F.col("sim") >= threshold).cast("int")) >= WIDE
    last = graph.groupBy("src").agg(F.when(full, F.lit(FULL)).when(F.count("*") >= K, F.min("sim")).otherwise(F.lit(-2.0)).alias("last"))
    held = nodes.join(last, nodes["node"] == last["src"], "left").select("node", "vec", F.coalesce("last", F.lit(-2.0)).alias("last"))
    rows = members.join(held, members["member"] == held["node"]).select("center", "member", "last", "vec")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def solve(b: pa.RecordBatch) -> pa.RecordBatch:
            center, member, last = (np.asarray(c) for c in b.columns[:3])
            found = []
            for i, j in _runs(center):
                if j - i < 2:
                    continue
                unit = _unit(b.column(3).slice(i, j - i), kind)
                sim = unit @ unit.T
                np.fill_diagonal(sim, -2)
                own, hit, bound = member[i:j], sim >= threshold, last[i:j, None]
                a, c = np.nonzero((hit & (bound < FULL)) | (sim > bound))
                found.append((own[a], own[c], sim[a, c], False))
                # Links with the center are list edges; they stay.
                middle = int(np.flatnonzero(own == center[i])[0])
                apart = ~hit[middle]
                apart[middle] = False
                if hit[apart].any():
                    a, c = (np.array(x) for x in _forest(hit, middle))
                    a, c = a[a != middle], c[a != middle]
                    found.append((own[a], own[c], sim[a, c], True))
            return _edges_batch(found)

        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            center = np.asarray(b.column(0))
            if not len(center):
                continue
            cut = int(np.searchsorted(center, center[-1], "left"))
            if cut:
                yield solve(b.slice(0, cut))
            held = b.slice(cut)
        if held is not None:
            yield solve(held)

    return rows.repartition("center").sortWithinPartitions("center").mapInArrow(join, EDGE)


PAIRED = "src long, dst long, near long, others long"


def _compare_all(blocks: DataFrame, scratch: Scratch, kind: str, threshold: float, forest: bool) -> DataFrame:
    """All pairs of equal block from (block, node, n, vec). Rows (src, near,
    others) are parts of a node's counts of nodes and of vectors that pass;
    with ``forest``, rows (src, dst) connect what passing pairs connect."""
    size = scratch.table(blocks.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1"), "tiles")
    tiles = F.coalesce("tiles", F.lit(1))
    own, other = F.pmod(F.xxhash64("node", F.lit(7)), tiles).cast("int"), F.explode(F.sequence(F.lit(0), tiles - 1))
    dealt = (blocks.join(size, "block", "left").withColumn("own", own).withColumn("other", other)
             .select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "vec")
             .repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "own", "node"))

    def solve(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, i, j, own, node, n = (np.asarray(c) for c in b.columns[:6])
        near, others = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        a, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p, q in _runs(block, i, j):
            if q - p < 2:
                continue
            unit = _unit(b.column(6).slice(p, q - p), kind)
            # Of two tiles only pairs across are compared here.
            cut = int(np.searchsorted(own[p:q], j[p])) if i[p] != j[p] else 0
            linked = np.zeros((q - p, q - p), bool) if forest else None
            for s in range(0, cut or q - p, 512):
                t = min(s + 512, cut or q - p)
                hit = unit[s:t] @ unit[cut:].T >= threshold
                if not cut:
                    hit[np.arange(t - s), np.arange(s, t)] = False
                near[p + s : p + t] += hit.sum(axis=1)
                others[p + s : p + t] += hit @ n[p + cut : q]
                if cut:
                    near[p + cut : q] += hit.sum(axis=0)
                    others[p + cut : q] += n[p + s : p + t] @ hit
                if forest:
                    linked[s:t, cut:] |= hit
                    linked[cut:, s:t] |= hit.T
            if forest:
                x, y = _forest(linked)
                a.append(node[p:q][x])
                c.append(node[p:q][y])
        own = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.nulls(len(own), pa.int64()), pa.array(near[own]), pa.array(others[own])], ["src", "dst", "near", "others"])
        a, c = np.concatenate(a), np.concatenate(c)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), *[pa.nulls(len(a), pa.int64())] * 2], ["src", "dst", "near", "others"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            block, i, j = (np.asarray(c) for c in b.columns[:3])
            first = _runs(block, i, j)[-1][0]
            if held and (first or any(held[-1].column(k)[-1] != b.column(k)[0] for k in range(3))):
                held.append(b.slice(0, first))
                yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            elif first:
                yield from solve(b.slice(0, first))
            held.append(b.slice(first))
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return dealt.mapInArrow(compare, PAIRED)


def _summed(pairs: DataFrame) -> DataFrame:
    """(node, near, others) of each node that links."""
    return pairs.where("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("near").alias("near"), F.sum("others").alias("others"))


def audit(nodes: DataFrame, degree: DataFrame, kind: str, threshold: float, seed: int = 99) -> list[tuple[int, int, int, int]]:
    """(label, vector bytes, links found, links there are) of each of
    ``AUDITED`` nodes chosen by hash, compared with all nodes of its label."""
    asked = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(AUDITED).select("node", "label", "vec")
    rows = asked.collect()
    if not rows:
        return []
    node, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    raw = [bytes(r[2]) for r in rows]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(raw), np.int64)
        for b in batches:
            own, own_label = np.asarray(b.column(0)), np.asarray(b.column(1))
            size = np.asarray(pc.binary_length(b.column(2)))
            for n in np.unique(size):
                here = np.flatnonzero(size == n)
                there = np.array([k for k, v in enumerate(raw) if len(v) == n], np.int64)
                if len(there):
                    a, c = _unit(b.column(2).take(pa.array(here)), kind), _unit(pa.array([raw[k] for k in there], pa.binary()), kind)
                    same = (own_label[here][:, None] == label[there]) & (own[here][:, None] != node[there])
                    total[there] += ((a @ c.T >= threshold) & same).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "n"])

    true = nodes.select("node", "label", "vec").mapInArrow(compare, "node long, n long").groupBy("node").agg(F.sum("n")).collect()
    true = dict(map(tuple, true))
    found = degree.where(F.col("node").isin([int(x) for x in node])).select("node", "near").collect()
    found = dict(map(tuple, found))
    return [(r[1], len(raw[k]), found.get(r[0], 0), true.get(r[0], 0)) for k, r in enumerate(rows)]


def link_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> tuple[DataFrame, dict]:
    """(vec_id, n_links, component_id, kept) per row, and the audit's figures.

    Vectors are compared where labels and lengths are equal. Null, empty and
    zero vectors, vectors with null or non-finite components and null labels
    link with nothing: no links, a component of their own. Repeated rows are
    vectors of their own that link. Null ids never name a component unless it
    has no other.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f8" if isinstance(element, T.DoubleType) else "<f4"
    v = F.col("v")
    fine = (F.col("label").isNotNull() & v.isNotNull() & (F.size("v") > 0)
            & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("int").alias("label"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.select("vec_id", "fine", "v", "label", F.xxhash64("label", "v").alias("h1"), F.xxhash64("v", "label", F.lit(3)).alias("h2"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.asarray(x.values, kind).tobytes() for x in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(raw, pa.binary())], ["h1", "h2", "n", "least", "label", "vec"])

    id_kind = rows.schema["vec_id"].dataType.simpleString()
    grouped = rows.where("fine").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = scratch.table(grouped.mapInArrow(packed, f"h1 long, h2 long, n long, least {id_kind}, label int, vec binary")
                          .withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = None
    for tree in range(TREES):
        leaves = _leaves(nodes, tree, kind, threshold)
        found = leaves if found is None else found.unionByName(leaves)
    graph, bridges, links = None, None, 0
    figures = {"rounds": 0, "found": 0, "true": 0}
    for turn in range(ROUNDS + 1):
        # Round 0 is the leaves.
        found = scratch.table(_descend(graph, nodes, turn, kind, threshold) if turn else found, f"found-{turn}")
        edges = found.where("not bridge").select("src", "dst", "sim", F.lit(False).alias("old"))
        better = scratch.table(_best(edges.unionByName(graph.withColumn("old", F.lit(True))) if turn else edges, threshold), f"graph-{turn}")
        own = found.where("bridge").select("src", "dst")
        bridges = own if bridges is None else bridges.unionByName(own)
        if turn:
            scratch.drop(graph)
        graph, before = better, links
        links = graph.where(F.col("sim") >= threshold).count()
        figures["rounds"] = turn
        if turn and links <= before * (1 + STILL):
            break
    # A link can be in one list only: both ends count it.
    kept = graph.where(F.col("sim") >= threshold).select("src", "dst").unionByName(bridges)
    kept = scratch.table(kept.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "links")
    both = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = nodes.select(F.col("node").alias("b"), F.col("n").alias("others"))
    parts = scratch.table(connected_components(kept, scratch), "components")
    degree = scratch.table(both.join(weights, "b").groupBy("a").agg(F.count("*").alias("near"), F.sum("others").alias("others")).withColumnRenamed("a", "node"), "degree")
    # A list that is saturated may lack links: its component is counted anew.
    dense = scratch.table(degree.where(F.col("near") >= K).join(parts, "node").select(F.col("component").alias("block")).distinct(), "dense")
    members = scratch.table(parts.join(dense, F.col("component") == F.col("block")).select("node", "block"), "members")
    pairs = _compare_all(members.join(nodes, "node").select("block", "node", "n", "vec"), scratch, kind, threshold, forest=False)
    exact = scratch.table(_summed(pairs), "exact")
    degree = scratch.table(degree.join(members, "node", "left_anti").unionByName(exact), "degrees")
    done: set[tuple[int, int]] = set()
    while True:
        audited = audit(nodes, degree, kind, threshold, 99 + len(done))
        figures["found"], figures["true"] = (sum(r[i] for r in audited) for i in (2, 3))
        if figures["found"] >= RECALL * figures["true"]:
            break
        missed = {r[:2] for r in audited if r[2] < r[3]}
        if missed <= done:
            raise RuntimeError(f"audit: {figures['found']} of {figures['true']} links after comparing all pairs")
        # At most AUDITED labels: those of the audited nodes.
        anew = nodes.where(F.struct("label", F.octet_length("vec")).isin([F.struct(F.lit(a), F.lit(b)) for a, b in sorted(missed - done)]))
        done |= missed
        anew = anew.select(F.xxhash64("label", F.octet_length("vec")).alias("block"), "node", "n", "vec")
        pairs = scratch.table(_compare_all(anew, scratch, kind, threshold, forest=True), "pairs")
        degree = scratch.table(degree.join(anew.select("node"), "node", "left_anti").unionByName(_summed(pairs)), "degrees")
        kept = kept.unionByName(pairs.where("dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b")))
        parts = scratch.table(connected_components(kept, scratch), "components")
    rooted = scratch.table(nodes.join(degree, "node", "left").join(parts, "node", "left").select(
        "h1", "h2", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")), "rooted")
    least = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    told = scratch.table(rooted.join(least, "root").select("h1", "h2", "n_links", "component_id"), "told")
    # Vectors that can't be compared share no key, so many of them make no hot one.
    left = rows.select("vec_id", F.when(F.col("fine"), F.col("h1")).otherwise(F.xxhash64("vec_id")).alias("h1"), F.when(F.col("fine"), F.col("h2")).alias("h2"))
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = left.join(told, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), figures
