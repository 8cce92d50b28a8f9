"""Paths between all nodes at once, walked node by node instead of level by level.

Edges meet their source once, in one shuffle; the edges that go on from some edge's target (inner ones) and the names of
targets go to all tasks as arrays, and each task walks from its own sources without another shuffle. Whoever is used by a
node is whoever uses it, so both directions are walks from sources; they differ in which of the shortest paths wins.
The same rows as ``traverse.traverse`` of all nodes, which takes over where names or inner edges are too many to send.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expr import is_usage, shown
from weftgraph.operators import traverse
from weftgraph.plans.staging import checkpointed
from weftgraph.sources.facts import unfolded, within

#: What is sent to every task: names of targets and their bytes, inner edges.
MOST_NAMES, MOST_BYTES, MOST_INNER = 3_000_000, 100_000_000, 8_000_000
#: Edges that are looked up and walked together (a look-up hashes all names anew), and candidates of a level, unless one
#: source has more.
EDGES, CANDIDATES = 500_000, 2_000_000
ROWS = 50_000  # of a batch of the result


class Inner:
    """Inner edges by their source, in the order of edges: arrays at ``first[node]`` to ``first[node + 1]``."""

    def __init__(self, at: np.ndarray, to: np.ndarray, kind: np.ndarray, nodes: int) -> None:
        by = np.argsort(at, kind="stable")
        self.to, self.kind, self.rank = to[by].astype(np.int32), kind[by].astype(np.int32), by.astype(np.int32)
        self.first = np.zeros(nodes + 1, np.int64)
        np.cumsum(np.bincount(at, minlength=nodes), out=self.first[1:])


def _first(code: np.ndarray, rank: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of the smallest rank of each code that isn't among the seen ones, in the order of codes."""
    every = np.concatenate([code, seen])
    place = np.concatenate([rank.astype(np.int64) + 1, np.zeros(len(seen), np.int64)])
    wide = int(place.max(initial=0)) + 1
    if int(every.max(initial=0)) < (1 << 62) // wide:
        order = np.argsort(every * wide + place)
    else:
        order = np.lexsort((place, every))
    sorted_codes = every[order]
    order = order[np.r_[True, sorted_codes[1:] != sorted_codes[:-1]]] if len(order) else order
    return order[order < len(code)]


def _levels(x: np.ndarray, own: np.ndarray, to: np.ndarray, kind: np.ndarray, inner: Inner, kinds: int, depth: int, incoming: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(distance, x, node, path) of sources x (ascending numbers, whose own nodes are ``own`` or -1) with edges in order.
    Outgoing paths compare from the source, and candidates arise in that order, so the first wins. Incoming ones compare
    from the node that is reached, so the last edge decides."""
    nodes = len(inner.first) - 1
    here = np.flatnonzero(own >= 0)
    seen = here * nodes + own[here]
    path, rank, found = kind.astype(np.int64), np.arange(len(x)), []
    node = to.astype(np.int64)
    for level in range(1, depth + 1):
        code = x * nodes + node
        won = _first(code, rank, seen)
        if not incoming:
            won = np.sort(won)
        x, node, path = x[won], node[won], path[won]
        found.append((level, x, node, path))
        if level == depth or not len(x):
            break
        seen = np.concatenate([seen, code[won]])
        n = inner.first[node + 1] - inner.first[node]
        total = int(n.sum())
        if total > CANDIDATES and len(own) > 1:
            raise _TooMany
        back = np.repeat(np.arange(len(x)), n)
        edge = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(inner.first[node], n)
        step = inner.kind[edge].astype(np.int64)
        path = step * kinds**level + path[back] if incoming else path[back] * kinds + step
        x, node, rank = x[back], inner.to[edge].astype(np.int64), inner.rank[edge] if incoming else np.arange(total)
    yield from found


class _TooMany(Exception):
    """More candidates than are walked at once."""


def _walked(x: np.ndarray, own: np.ndarray, to: np.ndarray, kind: np.ndarray, *rest) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The same in as many parts as candidates ask for."""
    try:
        yield from list(_levels(x, own, to, kind, *rest))
    except _TooMany:
        half = len(own) // 2
        cut = int(np.searchsorted(x, half))
        yield from _walked(x[:cut], own[:half], to[:cut], kind[:cut], *rest)
        for level, more, node, path in _walked(x[cut:] - half, own[half:], to[cut:], kind[cut:], *rest):
            yield level, more + half, node, path


def _paths(path: np.ndarray, level: int, kinds: list[str]) -> pa.Array:
    codes, at = np.unique(path, return_inverse=True)
    told = [[kinds[int(c) // len(kinds) ** (level - 1 - i) % len(kinds)] for i in range(level)] for c in codes]
    return pa.array(told, pa.list_(pa.string())).take(pa.array(at.ravel()))


def _text(column: pa.Array) -> pa.Array:
    return column.cast(pa.string()) if column.type != pa.string() else column


def _sources(batches: Iterator[pa.RecordBatch], names: pa.Array, kinds: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(names of sources that are nodes, their numbers or -1, x, to, kind) of rows sorted by source, a node's own row
    (without a target) before its edges; edges to what is no node are left out."""

    def coded(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        source, target = (_text(rows.column(c).combine_chunks()) for c in ("source_id", "target_id"))
        new = np.r_[True, pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False)]
        x = np.cumsum(new) - 1
        node = ~target.is_valid().to_numpy(zero_copy_only=False)
        is_node = np.zeros(int(x[-1]) + 1, bool)
        is_node[x[node]] = True
        kind = pc.fill_null(pc.index_in(_text(rows.column("shown").combine_chunks()), kinds, skip_nulls=True), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(is_node) - 1
        who = source.filter(pa.array(new)).filter(pa.array(is_node))
        at = pc.fill_null(pc.index_in(pa.concat_arrays([target, who]), names, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        to, own = at[: len(target)], at[len(target) :].astype(np.int64)
        keep = is_node[x] & (to >= 0)
        return who, own, number[x[keep]], to[keep], kind[keep]

    yield from map(coded, whole_sources(batches))


def whole_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by source in tables of some EDGES rows, all rows of a source in one."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < EDGES:
            continue
        table = pa.Table.from_batches(held)
        source = table.column("source_id").combine_chunks()
        cut = pc.index(source, source[-1]).as_py()  # the last source may go on
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), len(source) - cut if cut else 0
    if held:
        yield pa.Table.from_batches(held)


def _inner_edges(batches: Iterator[pa.RecordBatch], names: object) -> Iterator[pa.RecordBatch]:
    def kept(some: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(some)
        rows = rows.filter(pc.is_valid(rows.column("target_id")))
        return rows.filter(pc.is_in(_text(rows.column("source_id").combine_chunks()), names.value[0], skip_nulls=True)).to_batches()

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGES:
            yield from kept(held)
            held, rows = [], 0
    if held:
        yield from kept(held)


def _walk(batches: Iterator[pa.RecordBatch], sent: object, depth: int, incoming: bool, paths: bool) -> Iterator[pa.RecordBatch]:
    names, kinds, inner = sent.value
    told = kinds.to_pylist()
    for who, own, x, to, kind in _sources(batches, names, kinds):
        for level, at, node, path in _walked(x, own, to, kind, inner, max(len(told), 1), depth, incoming):
            for i in range(0, len(at), ROWS):
                part = slice(i, i + ROWS)
                ends = [who.take(pa.array(at[part])), names.take(pa.array(node[part]))]
                columns = [*(ends[::-1] if incoming else ends), pa.array(np.full(len(at[part]), level, np.int32))]
                columns += [_paths(path[part], level, told)] if paths else []
                yield pa.RecordBatch.from_arrays(columns, ["root", "node", "distance", "relation_path"][: len(columns)])


def traverse_all(nodes: DataFrame, edges: DataFrame, depth: int, incoming: bool, paths: bool = True) -> DataFrame:
    """(root, node, distance, relation_path if asked for) of what each node uses, or (incoming) is used by. Equal edges
    count once."""
    usage = edges.where(is_usage()).where("source_id is not null and target_id is not null")
    ids = nodes.select("id").where("id is not null")
    told = checkpointed(usage.select(F.col("target_id").alias("id"), shown().alias("shown")).distinct().join(ids, "id", "left_semi"))
    kinds = sorted(r[0] for r in told.select("shown").distinct().limit(1001).collect())
    names = checkpointed(told.select("id").distinct())
    count, size = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()
    rest = lambda: _rest(nodes, edges, depth, incoming, paths)
    if depth < 1 or count > MOST_NAMES or size > MOST_BYTES or len(kinds) > 1000 or max(len(kinds), 2) ** depth >= 1 << 62:
        return rest()
    kind = F.coalesce("type", F.lit(""))
    own = ids.select(F.col("id").alias("source_id"), *[F.lit(None).cast("string").alias(c) for c in ("target_id", "kind", "shown")], F.lit("").alias("eid"))
    # An edge's ends and type are parts of its id, as which they are shuffled.
    edge = usage.select("source_id", F.col("target_id"), kind.alias("kind"), shown().alias("shown"), F.coalesce("id", F.lit("")).alias("eid"))
    ends = ["target_id", "kind", "shown"]
    met = own.unionByName(edge).select("source_id", "eid", *within(ends, "eid")).repartition("source_id").select("source_id", "eid", *unfolded(ends, "eid"))
    order = ["source_id", F.col("target_id").isNotNull(), "eid", "target_id", "kind"]
    # One group of rows a file, so that one task reads it whole and in its order.
    met = checkpointed(met.sortWithinPartitions(*order), **{"parquet.block.size": 2_000_000_000})
    sc = nodes.sparkSession.sparkContext
    texts = _text(names.toArrow().column("id").combine_chunks())
    sent = sc.broadcast((texts,))
    inner = checkpointed(met.select("source_id", "target_id", "shown", "eid", "kind").mapInArrow(partial(_inner_edges, names=sent), "source_id string, target_id string, shown string, eid string, kind string"))
    inner = inner.join(names.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    if inner.count() > MOST_INNER:
        return rest()
    steps = inner.orderBy("eid", "source_id", "target_id", "kind").select("source_id", "target_id", "shown").toArrow()
    at, to = (pc.index_in(_text(steps.column(c).combine_chunks()), texts).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("source_id", "target_id"))
    type_at = pc.index_in(_text(steps.column("shown").combine_chunks()), pa.array(kinds, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    sent = sc.broadcast((texts, pa.array(kinds, pa.string()), Inner(at, to, type_at, len(texts))))
    shape = "root string, node string, distance int" + (", relation_path array<string>" if paths else "")
    return met.select("source_id", "target_id", "shown").mapInArrow(partial(_walk, sent=sent, depth=depth, incoming=incoming, paths=paths), shape)


def _rest(nodes: DataFrame, edges: DataFrame, depth: int, incoming: bool, paths: bool) -> DataFrame:
    nodes, edges = checkpointed(nodes), checkpointed(edges.distinct())
    found = traverse.traverse(nodes, edges, nodes, depth, incoming)
    return found if paths else found.drop("relation_path")
