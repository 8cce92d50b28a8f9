"""Relationships of all nodes at once: the rows of ``context.build_relationships`` with every node as a root.

Edges meet their source once, in one shuffle, and become numbers there: of the nodes that some edge ends at, whose names go
to all tasks (as in ``walks``), and of files. What uses what is walked from the sources and told from both ends. Callers of
methods are walked by family, over those edges only that lead to a member within the depth. Files that a file needs and
serves are sent to all tasks as a list each, and told for its symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expr import fold, is_family, is_semantic, is_usage, path_key
from weftgraph.operators import context, files, traverse, walks
from weftgraph.operators.components import components
from weftgraph.plans.adapter import Graph
from weftgraph.plans.staging import checkpointed

#: What is sent to every task besides walks' names and inner edges: paths of files, links between files (beyond, a join).
MOST_FILES, MOST_LINKS = 1_000_000, 200_000
#: Rows of files and symbols that a task of the result tells.
TOLD = 8_000_000
#: Families are sought from called members, so many steps at most, while no step finds more nodes.
FEW, STEPS = 100_000, 8
USAGE, SEMANTIC, KIN = 1, 2, 4
CODED = "id string, head boolean, file int, own int, targets array<int>, kin array<string>, links array<long>, odd boolean"


def _lists(x: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """A list for each of n rows; x: the rows of the values, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(x, minlength=n))].astype(np.int32)), values)


def _unique(code: np.ndarray) -> np.ndarray:
    code = np.sort(code)  # np.unique hashes, which takes several times as long here
    return code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code


def _coded(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    """A row per node out of rows sorted by source, its own before its edges, with numbers of targets; and for each batch a
    row without id: links between files as one number each, and whether a node was told in two ways."""
    names, is_used, file_of, paths, keys = sent.value
    for table in walks.whole_sources(batches):
        source, target, path = (walks._text(table.column(c).combine_chunks()) for c in ("source_id", "target_id", "file_path"))
        kind = table.column("kind").combine_chunks().to_numpy(zero_copy_only=False)
        new = np.r_[True, pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False)]
        x = np.cumsum(new) - 1
        is_edge = target.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(~is_edge)
        again = np.r_[False, x[at[1:]] == x[at[:-1]]]
        odd = bool((again & (kind[at] != np.r_[0, kind[at[:-1]]])).any()) if len(at) else False
        at = at[~again]
        heads = kind[at]
        n = len(at)
        number = np.full(int(x[-1]) + 1, -1)
        number[x[at]] = np.arange(n)
        who = source.take(pa.array(at))
        file = pc.fill_null(pc.index_in(path.take(pa.array(at)), paths, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(is_edge & (number[x] >= 0))
        found = pc.fill_null(pc.index_in(pa.concat_arrays([target.take(pa.array(edge)), who]), names, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        own, to, x, kind = found[len(edge) :], found[: len(edge)].astype(np.int64), number[x[edge]], kind[edge]
        own = np.where(is_used[own], own, -1) if len(names) else own  # no walk comes to the others
        lists = []
        for bit in (USAGE, KIN):
            some = (kind & bit > 0) & (to >= 0)
            code = _unique(x[some] * max(len(names), 1) + to[some])
            lists.append((code // max(len(names), 1), (code % max(len(names), 1)).astype(np.int32)))
        some = (kind & SEMANTIC > 0) & (to >= 0)
        a, b = file[x[some]].astype(np.int64), file_of[to[some]].astype(np.int64)
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        apart = keys[a] != keys[b]
        links = _unique(a[apart] * len(paths) + b[apart])
        kin = _lists(lists[1][0], names.take(pa.array(lists[1][1])), n)
        head = pa.array(heads & 1 > 0)
        none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.bool_())]
        shape = ["id", "head", "file", "own", "targets", "kin", "links", "odd"]
        if n:
            yield pa.RecordBatch.from_arrays([who, head, pa.array(file.astype(np.int32)), pa.array(own.astype(np.int32)), _lists(lists[0][0], pa.array(lists[0][1]), n), kin, *none], shape)
        if len(links) or odd:
            types = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], _lists(np.zeros(len(links), np.int64), pa.array(links), 1), pa.array([odd])], shape)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, own numbers, x, targets) of coded rows."""
    for batch in batches:
        if batch.num_rows:
            targets = batch.column("targets")
            x = np.repeat(np.arange(batch.num_rows), pc.list_value_length(targets).to_numpy(zero_copy_only=False))
            yield walks._text(batch.column("id")), batch.column("own").to_numpy(zero_copy_only=False).astype(np.int64), x, targets.flatten().to_numpy(zero_copy_only=False)


def _walk(batches: Iterator[pa.RecordBatch], sent: object, depth: int) -> Iterator[pa.RecordBatch]:
    names, inner, is_head = sent.value
    back = pa.array(~is_head)
    for who, own, x, to in _batches(batches):
        for level, at, node, _ in walks._walked(x, own, to, np.zeros(len(x), np.int32), inner, 1, depth, False):
            for i in range(0, len(at), walks.ROWS):
                part = slice(i, i + walks.ROWS)
                ends = [pa.array(at[part]), pa.array(node[part])]
                columns = [who.take(ends[0]), names.take(ends[1]), pa.array(np.full(len(ends[0]), level, np.int32)), back.take(ends[1])]
                yield pa.RecordBatch.from_arrays(columns, ["root", "node", "distance", "back"])


def _leading(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    """Edges to some of the targets, as names."""
    names, leads = sent.value
    for who, _, x, to in _batches(batches):
        kept = leads[to]
        if kept.any():
            yield pa.RecordBatch.from_arrays([who.take(pa.array(x[kept])), names.take(pa.array(to[kept]))], ["source", "target"])


def _kin_of(kin: DataFrame, called: DataFrame) -> DataFrame:
    """Those links (a, b) whose families have a called member, where they are many and such members few; else all."""
    if kin.count() <= FEW:
        return kin
    both = kin.union(kin.select("b", "a"))
    near = fresh = called.select(F.col("node").alias("a"))
    for _ in range(STEPS):
        if fresh.count() > FEW:
            return kin
        far = both.join(F.broadcast(fresh), "a").select(F.col("b").alias("a")).distinct()
        fresh = checkpointed(far.join(near, "a", "left_anti"))
        if fresh.isEmpty():
            return kin.join(F.broadcast(near), "a", "left_semi")
        near = near.union(fresh)
    return kin


def _used_by_family(coded: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance) of callers of the family of each method, over (source, target) that lead to members."""
    called = checkpointed(pairs.select(F.col("target").alias("node")).distinct())
    family = components(_kin_of(checkpointed(coded.select(F.col("id").alias("a"), F.explode("kin").alias("b"))), called))
    heads = checkpointed(called.join(family, "node", "left").select(F.coalesce("head", "node").alias("head")).distinct())
    members = family.join(heads, "head", "left_semi").select("head", "node").union(heads.select("head", F.col("head").alias("node"))).distinct()
    members = checkpointed(members)
    found = traverse.reach(members.select(F.col("head").alias("root"), "node"), pairs.select(F.col("target").alias("at"), F.col("source").alias("to")), depth)
    methods = coded.where("head and id <> ''").select(F.col("id").alias("node"))
    roots = members.join(methods, "node", "left_semi").withColumnRenamed("node", "root")
    return checkpointed(roots.join(found.where("distance > 0").withColumnRenamed("root", "head"), "head").select("root", "node", "distance"))


def _files_told(coded: DataFrame, told: DataFrame, links: DataFrame) -> DataFrame:
    """(root, section, node, distance) of the files that each symbol's file needs and serves. told: (file, at), paths with their numbers."""
    lists = None
    for section, incoming in (("fileDependencies", False), ("fileDependents", True)):
        of = files.told_links(links, incoming).join(told, "file").select("at", F.lit(section).alias("section"), F.col("other").alias("node"))
        lists = of if lists is None else lists.union(of)
    lists = checkpointed(lists)
    symbols = coded.where("file >= 0 and id <> ''").select(F.col("id").alias("root"), F.col("file").alias("at"))
    sizes = lists.groupBy("at").agg(F.count("*").alias("links"))
    n, rows = symbols.groupBy("at").count().join(sizes, "at").agg(F.sum("links"), F.sum(F.col("count") * F.col("links"))).first()
    if not n:
        return symbols.limit(0).select("root", F.lit("").alias("section"), F.col("root").alias("node"), F.lit(1).alias("distance"))
    if n > MOST_LINKS:
        return symbols.join(lists, "at").select("root", "section", "node", F.lit(1).alias("distance"))
    own = F.broadcast(lists.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("section", "node"))).alias("told")))
    spread = symbols.repartition(math.ceil(rows / TOLD), "root")  # by rows told, of which their own bytes say nothing
    return spread.join(own, "at").select("root", F.explode("told").alias("told")).select("root", "told.section", "told.node", F.lit(1).alias("distance"))


def of_all(graph: Graph, depth: int) -> DataFrame:
    """(root, section, node, distance) as ``context.build_relationships`` of all nodes. Equal edges count once."""
    nodes, edges = graph.nodes.where("id is not null"), graph.edges
    edge = edges.where("source_id is not null and target_id is not null")
    bits = F.when(is_usage(), USAGE).otherwise(0) + F.when(is_semantic(), SEMANTIC).otherwise(0) + F.when(is_family(), KIN).otherwise(0)
    edge = edge.select("source_id", "target_id", bits.cast("long").alias("kind")).where("kind > 0")
    is_head = F.coalesce(fold("type"), F.lit("")) == "METHOD"
    ends = edge.groupBy(F.col("target_id").alias("id")).agg(F.max(F.col("kind").bitwiseAND(USAGE)).alias("used"), F.max(F.col("kind").bitwiseAND(KIN)).alias("kin"))
    names = checkpointed(ends.join(nodes.select("id", is_head.alias("head"), "file_path"), "id"))
    paths = checkpointed(nodes.where("file_path <> ''").select("file_path").distinct().select("file_path", path_key("file_path").alias("key")))
    count, size = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()
    if depth < 1 or count > walks.MOST_NAMES or size > walks.MOST_BYTES or paths.count() > MOST_FILES:
        return _rest(graph, depth)
    sc = nodes.sparkSession.sparkContext
    told = paths.toArrow()
    path, key = (walks._text(told.column(c).combine_chunks()) for c in ("file_path", "key"))
    table = names.toArrow()
    texts = walks._text(table.column("id").combine_chunks())
    file_of = pc.fill_null(pc.index_in(walks._text(table.column("file_path").combine_chunks()), path, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    head_of, kin_of = table.column("head").to_numpy(), table.column("kin").to_numpy() > 0
    sent = sc.broadcast((texts, table.column("used").to_numpy() > 0, file_of, path, pc.index_in(key, pc.unique(key)).to_numpy(zero_copy_only=False)))
    # A node's own number tells whether it is a method and, by its other bits, nodes that share an id and differ.
    mark = F.xxhash64(F.struct("type", "file_path", "namespace")).bitwiseAND(-2) + is_head.cast("long")
    own = nodes.select(F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id"), mark.alias("kind"), "file_path")
    met = own.union(edge.withColumn("file_path", F.lit(None).cast("string"))).repartition("source_id")
    # By hash first: ids begin alike, so that a sort by them alone compares them whole.
    met = met.sortWithinPartitions(F.xxhash64("source_id"), "source_id", F.col("target_id").isNotNull(), "kind")
    coded = checkpointed(met.mapInArrow(partial(_coded, sent=sent), CODED))
    found = coded.where("id is null").select("links", "odd")
    if not found.where("odd").isEmpty():
        return _rest(graph, depth)
    some = coded.where("own >= 0 and size(targets) > 0").select("own", "targets")
    if (some.agg(F.coalesce(F.sum(F.size("targets")), F.lit(0))).first()[0]) > walks.MOST_INNER:
        return _rest(graph, depth)
    table = some.toArrow()
    targets = table.column("targets").combine_chunks()
    to = targets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(table.column("own").to_numpy(), pc.list_value_length(targets).to_numpy(zero_copy_only=False)).astype(np.int64)
    # Edges that may lead to a method, or to one of its family, within the depth.
    leads = head_of | kin_of
    leads[coded.where("own >= 0 and size(kin) > 0").select("own").toArrow().column("own").to_numpy()] = True
    for _ in range(depth - 1):
        leads[at[leads[to]]] = True
    using = coded.where("size(targets) > 0").select("id", "own", "targets")
    pairs = checkpointed(using.mapInArrow(partial(_leading, sent=sc.broadcast((texts, leads))), "source string, target string"))
    sent = sc.broadcast((texts, walks.Inner(at, to, np.zeros(len(at), np.int32), len(texts)), head_of))
    walked = using.mapInArrow(partial(_walk, sent=sent, depth=depth), "root string, node string, distance int, back boolean")
    near = lambda x, y: F.when(F.col("distance") == 1, x).otherwise(y).alias("section")
    there = F.struct("root", near("uses", "transitiveUses"), "node", "distance")
    back = F.struct(F.col("node").alias("root"), near("usedBy", "transitiveUsedBy"), F.col("root").alias("node"), "distance")
    out = walked.select(F.inline(F.when(F.col("back"), F.array(there, back)).otherwise(F.array(there)))).where("root <> ''")
    by_family = _used_by_family(coded, pairs, depth)
    out = out.union(by_family.select("root", near("usedBy", "transitiveUsedBy"), "node", "distance"))
    n = len(path)
    number = checkpointed(nodes.sparkSession.createDataFrame(pa.table({"file": path, "at": pa.array(np.arange(n, dtype=np.int32))})))
    code = found.select(F.explode("links").alias("code")).distinct().select(F.expr(f"code div {n}").cast("int").alias("a"), (F.col("code") % n).cast("int").alias("b"))
    links = checkpointed(code.join(number.toDF("from_file", "a"), "a").join(number.toDF("to_file", "b"), "b").select("from_file", "to_file"))
    return out.union(_files_told(coded, number, links))


def _rest(graph: Graph, depth: int) -> DataFrame:
    nodes = checkpointed(graph.nodes)
    return context.build_relationships(Graph(nodes, checkpointed(graph.edges.distinct())), nodes, depth)
