"""Test evidence of all nodes at once: what ``evidence.evidence`` of every node as a root holds, told from the tests.

Edges of tests meet their test in one task, with the roots that its names speak for; edges that go on, families and
containers go to all tasks as arrays. So a task knows all that a test says of a root, and tells it as counts by root and
file: no pair of root and test goes through a shuffle. Names inside names are windows of a text whose hash is some name's,
by a bitmap that goes to all tasks; an equi-join confirms them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expr import CONTAINMENT, fold, is_family, is_usage
from weftgraph.operators import evidence, relations, walks
from weftgraph.operators.components import components
from weftgraph.operators.traverse import resolved
from weftgraph.plans.adapter import Graph
from weftgraph.plans.staging import checkpointed

#: What an edge of a test is, and (from HINT) what a test says of a root.
USES, CALLS, IMPLEMENTS = 1, 2, 4
IMPLEMENTER, REFERENCE, NEAR, FAR, DIRECT, DISPATCH, MEMBER, HINT = (1 << i for i in range(8))
BY_METHOD = NEAR | FAR | DIRECT | DISPATCH | MEMBER
#: Counts by root and file: sources or methods of each tag, of references by any way, of methods, of names' methods and names.
COUNTS = ("implementer", "reference", "near", "far", "direct", "dispatch", "member", "heuristic", "sources", "methods", "named")
#: Bits of the hash of a name and of its length and beginning; bytes of the latter.
BITS, START_BITS, START = 29, 22, 4
MOST_MEMBERS = 4_000_000  # of families and containers, sent to every task
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _placed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class _Windows:
    """Hashes of windows of texts that lie behind one another."""

    def __init__(self, texts: pa.Array) -> None:
        texts = walks._text(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.bytes = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.first, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        n = len(self.bytes)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64)])
        self.back = _powers(_BACK, n)

    def of(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sum[at + n] - self.sum[at]) * self.back[at]

    def start(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return _placed(self.of(at, np.minimum(n, START)) + np.asarray(n, np.uint64) * np.uint64(0xFF51AFD7ED558CCD), START_BITS)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of names in the bitmaps, and their lengths: (which, place)."""
    for batch in batches:
        if batch.num_rows:
            texts = pc.drop_null(batch.column(0))
            w = _Windows(texts)
            at, n = w.first[w.size > 0], w.size[w.size > 0]
            told = [np.unique(x) for x in (_placed(w.of(at, n), BITS), w.start(at, n), n)]
            which = np.repeat(np.arange(3, dtype=np.int8), [len(x) for x in told])
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate(told).astype(np.int32))], ["which", "place"])


def _bitmap(places: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[places] = True
    return np.packbits(out, bitorder="little")


def _has(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _candidates(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    """(id, how, part) of the windows of texts (id, how, text) that may be names."""
    whole, start, lengths = sent.value
    for batch in batches:
        if not batch.num_rows:
            continue
        w = _Windows(batch.column("text"))
        text = np.repeat(np.arange(batch.num_rows), w.size)
        left = (w.first + w.size)[text] - np.arange(len(text))
        inside = w.bytes & 0xC0 == 0x80  # a character's later bytes
        for n in lengths:
            at = np.flatnonzero((left >= n) & ~inside)
            at = at[_has(start, w.start(at, n))]
            at = at[_has(whole, _placed(w.of(at, n), BITS))]
            at = at[(left[at] == n) | ~inside[np.minimum(at + n, len(inside) - 1)]]
            for i in range(0, len(at), 4 * walks.ROWS):
                some = at[i : i + 4 * walks.ROWS]
                parts = pa.StringArray.from_buffers(len(some), pa.py_buffer((np.arange(len(some) + 1) * n).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(w.bytes[some[:, None] + np.arange(n)])))
                of = pa.array(text[some])
                yield pa.RecordBatch.from_arrays([walks._text(batch.column("id").take(of)), batch.column("how").take(of), parts], ["id", "how", "part"])


def names_in(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(root, id, how) of texts (id, how, text) that hold a root's name (root, low, short, or where how is 1 also what
    follows "test"), staged; some more than once."""
    names = named.select(F.inline(F.array(F.struct(F.col("low").alias("part"), "root", F.lit(False).alias("is_short")), F.struct(F.col("short").alias("part"), "root", F.lit(True).alias("is_short")))))
    told = names.select("part").mapInArrow(_marks, "which byte, place int").toArrow()
    which, place = (told.column(c).to_numpy() for c in ("which", "place"))
    sent = names.sparkSession.sparkContext.broadcast((_bitmap(place[which == 0], BITS), _bitmap(place[which == 1], START_BITS), np.unique(place[which == 2]).tolist()))
    del told, which, place
    met = texts.where("text <> ''").select("id", "how", "text").mapInArrow(partial(_candidates, sent=sent), "id string, how int, part string")
    return checkpointed(met.join(names.hint("shuffle_hash"), "part").where("not is_short or how = 1").select("root", "id", "how"))


def _csr(at: np.ndarray, to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(at, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(at, minlength=n))].astype(np.int64), to[by].astype(np.int64)


def _spread(lists: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``at``, values) of the lists of each."""
    first, to = lists
    n = first[at + 1] - first[at]
    back = np.repeat(np.arange(len(at)), n)
    return back, to[np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)]


def _merged(code: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and all their bits."""
    if not len(code):
        return code, bits
    by = np.argsort(code)
    code, bits = code[by], bits[by]
    at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[at], np.bitwise_or.reduceat(bits, at)


def _said(sent: tuple, depth: int, own: np.ndarray, is_method: np.ndarray, x: np.ndarray, to: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x * names + root, what test x says of it) by edges (x, to, kind) of tests, x ascending."""
    names, inner, is_root, family, roots, holders = sent
    n = max(len(names), 1)
    code, bits = _merged(x * n + to, kind)
    x, to = code // n, code % n
    told = [(code, np.where(bits & IMPLEMENTS > 0, IMPLEMENTER, 0) | np.where(bits & USES > 0, REFERENCE, 0))]
    walk = is_method[x]
    for level, at, node, _ in walks._walked(x[walk], own, to[walk], np.zeros(int(walk.sum()), np.int32), inner, 1, depth, False):
        told.append((at * n + node, np.full(len(at), NEAR if level == 1 else FAR)))
    called = walk & (bits & CALLS > 0)
    cx, called = x[called], to[called]
    code, bits = _merged(*(np.concatenate(c) for c in zip(*told)))
    x, node = code // n, code % n
    out = [(code[is_root[node]], bits[is_root[node]]), (cx[is_root[called]] * n + called[is_root[called]], np.full(int(is_root[called].sum()), DIRECT))]
    many = len(roots[0]) - 1
    if many:
        # A family's bits are its members'; the nearest one counts, and none for a test of its own.
        mine = np.where(own >= 0, family[own], -1)
        some = family[node] >= 0
        fcode, fbits = _merged(x[some] * many + family[node[some]], bits[some])
        fx, f = fcode // many, fcode % many
        fbits = np.where(fbits & NEAR > 0, fbits & ~FAR, fbits)
        fbits = np.where(mine[fx] == f, fbits & ~(NEAR | FAR), fbits)
        back, root = _spread(roots, f)
        out.append((fx[back] * n + root, fbits[back]))
        some = family[called] >= 0
        back, root = _spread(roots, family[called[some]])
        out.append((cx[some][back] * n + root, np.where(root == called[some][back], DIRECT, DISPATCH)))
    back, root = _spread(holders, called)
    out.append((cx[back] * n + root, np.full(len(back), MEMBER)))
    code, bits = _merged(*(np.concatenate(c) for c in zip(*out)))
    return code[bits > 0], bits[bits > 0]


def _told(batches: Iterator[pa.RecordBatch], sent: object, depth: int, shape: str) -> Iterator[pa.RecordBatch]:
    """Out of rows sorted by test, its own before its edges and the roots that names give it. shape: "heuristics" (root,
    file, method), "counts" (root, file and COUNTS), "methods" (and a list of the first methods)."""
    names = sent.value[0]
    for table in walks.whole_sources(batches):
        source, target = (walks._text(table.column(c).combine_chunks()) for c in ("source_id", "target_id"))
        kind, file, line = (table.column(c).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for c in ("kind", "file", "line"))
        x = np.cumsum(np.r_[True, pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False)]) - 1
        mine = np.flatnonzero(~target.is_valid().to_numpy(zero_copy_only=False))  # a row for each test
        if len(mine) != x[-1] + 1:
            raise ValueError("a test without its own row")
        who, file, line, is_method = source.take(pa.array(mine)), file[mine].astype(np.int64), line[mine], kind[mine] > 0
        found = pc.fill_null(pc.index_in(pa.concat_arrays([target, who]), names, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        to, own = found[: len(target)], found[len(target) :]
        hint = kind == HINT
        edge = ~hint & (to >= 0)
        edge[mine] = False
        code, bits = _said(sent.value, depth, own, is_method, x[edge], to[edge], kind[edge].astype(np.int64))
        n = max(len(names), 1)
        # Roots that no edge leads to have numbers of this table only.
        other = np.flatnonzero(hint & (to < 0))
        more = target.take(pa.array(other)).dictionary_encode()
        to[other] = n + more.indices.to_numpy(zero_copy_only=False)
        wide = n + len(more.dictionary)
        code, bits = _merged(np.concatenate([code // n * wide + code % n, x[hint] * wide + to[hint]]), np.concatenate([bits, np.full(int(hint.sum()), HINT)]))
        x, root = code // wide, code % wide
        new = (bits & HINT > 0) & (bits & BY_METHOD == 0)
        every = pa.concat_arrays([names, *([pa.nulls(1, pa.string())] if not len(names) else []), more.dictionary])
        if shape == "heuristics":
            for i in range(0, int(new.sum()), walks.ROWS):
                at = np.flatnonzero(new)[i : i + walks.ROWS]
                yield pa.RecordBatch.from_arrays([every.take(pa.array(root[at])), pa.array(file[x[at]].astype(np.int32)), who.take(pa.array(x[at]))], ["root", "file", "method"])
            continue
        files = int(file.max()) + 1
        by = np.argsort(root * files + file[x], kind="stable")
        x, root, bits, new = x[by], root[by], bits[by], new[by]
        group = root * files + file[x]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
        told = [bits & b > 0 for b in (IMPLEMENTER, REFERENCE, NEAR, FAR, DIRECT, DISPATCH, MEMBER)]
        told += [new, bits & (REFERENCE | NEAR | FAR) > 0, (bits & BY_METHOD > 0) | new, bits & HINT > 0]
        counts = [(np.add.reduceat(c.astype(np.int32), first) if len(first) else first).astype(np.int32) for c in told]
        lists = [_first_methods(first, x, told[9], line, who)] if shape == "methods" else []
        for i in range(0, len(first), walks.ROWS):
            at = first[i : i + walks.ROWS]
            columns = [every.take(pa.array(root[at])), pa.array(file[x[at]].astype(np.int32)), *[pa.array(c[i : i + walks.ROWS]) for c in counts], *[c.slice(i, len(at)) for c in lists]]
            yield pa.RecordBatch.from_arrays(columns, ["root", "file", *COUNTS, "first"][: len(columns)])


def _first_methods(first: np.ndarray, x: np.ndarray, is_method: np.ndarray, line: np.ndarray, who: pa.Array) -> pa.ListArray:
    """The first methods by line and id of each group that begins at ``first``; tests are ascending, so x stands for the id."""
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
    at = np.flatnonzero(is_method)
    at = at[np.lexsort((x[at], line[x[at]], group[at]))]
    g = group[at]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else g
    kept = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)])) < evidence.METHODS
    at, g = at[kept], g[kept]
    told = pa.StructArray.from_arrays([pa.array(line[x[at]].astype(np.int32)), who.take(pa.array(x[at]))], ["line", "method"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(g, minlength=len(first)))].astype(np.int32)), told)


def _numbered(batches: Iterator[pa.RecordBatch], sent: object) -> Iterator[pa.RecordBatch]:
    """Pairs of names as numbers, where both have one. Many rows at once, for a look-up hashes all names anew."""
    names = sent.value

    def coded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (pc.fill_null(pc.index_in(walks._text(c.combine_chunks()), names, skip_nulls=True), -1).to_numpy(zero_copy_only=False) for c in pa.Table.from_batches(held).columns)
        both = (a >= 0) & (b >= 0)
        return pa.RecordBatch.from_arrays([pa.array(a[both]), pa.array(b[both])], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= walks.EDGES:
            yield coded(held)
            held, rows = [], 0
    if rows:
        yield coded(held)


class TooWide(Exception):
    """More than is sent to every task, or nodes that share an id: to be told from roots."""


def _pairs(pairs: DataFrame, names: object, most: int) -> tuple[np.ndarray, np.ndarray]:
    some = checkpointed(pairs.mapInArrow(partial(_numbered, sent=names), "a int, b int"))
    if some.count() > most:
        raise TooWide
    table = some.toArrow()
    return tuple(table.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))


def told(nodes: DataFrame, edges: DataFrame, shape: str, depth: int = evidence.DEPTH) -> tuple[DataFrame, DataFrame]:
    """(rows of ``shape`` for all nodes as roots, files as (file, path, key, n)). Equal edges count once."""
    nodes = nodes.where("id is not null")
    is_head = F.coalesce(fold("type"), F.lit("")) == "METHOD"
    is_named = F.coalesce("name", F.lit("")) != ""
    tests = checkpointed(evidence.test_symbols(nodes))
    listed = tests.groupBy("key", F.col("file").alias("path")).agg(F.count("*").alias("n")).orderBy("key").toArrow()
    ids, count = tests.agg(F.count_distinct("id"), F.count("*")).first()
    if ids != count or listed.num_rows > relations.MOST_FILES or depth < 1:
        raise TooWide
    spark = nodes.sparkSession
    files = checkpointed(spark.createDataFrame(listed.append_column("file", pa.array(np.arange(listed.num_rows, dtype=np.int32)))).select("file", "path", "key", "n"))
    tests = tests.drop("file").join(files.select("key", "file"), "key")

    usage = edges.where(is_usage()).where("source_id is not null and target_id is not null")
    bits = F.when(F.col("type") == "IMPLEMENTS", IMPLEMENTS).when(F.col("type").isin("CALLS", "MOCK_CALLS"), USES | CALLS).otherwise(USES)
    usage = usage.select("source_id", "target_id", bits.alias("kind"))
    ends = checkpointed(usage.select(F.col("target_id").alias("id")).distinct().join(nodes.select("id", is_head.alias("head"), is_named.alias("named")), "id"))
    marks = tests.select("id", F.lit(True).alias("test")).union(ends.select("id", F.lit(False)))
    marks = marks.groupBy("id").agg(F.max("test").alias("test"), F.min("test").alias("only_test"))
    met = usage.join(marks.withColumnRenamed("id", "source_id").hint("shuffle_hash"), "source_id")
    met = checkpointed(met.select("source_id", "target_id", "kind", "test", (~F.col("only_test")).alias("inner")))

    # Names: what edges lead to, families of these, and what holds what is called.
    own = ends.select("id")
    kin = edges.where(is_family()).where("source_id is not null and target_id is not null").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    kin = checkpointed(kin)
    related = checkpointed(ends.select(F.col("id").alias("node")).join(kin.select(F.explode(F.array("a", "b")).alias("node")), "node", "left_semi"))
    kin = resolved(relations._kin_of(kin, related).toDF("source_id", "target_id"), nodes).toDF("a", "b")
    family = components(kin)
    family = checkpointed(family.join(family.join(related, "node").select("head").distinct(), "head", "left_semi").select("node", "head"))
    called = met.where(F.col("test") & (F.col("kind").bitwiseAND(CALLS) > 0)).select(F.col("target_id").alias("member")).distinct()
    held = edges.where(fold("type").isin(*CONTAINMENT)).select(F.col("source_id").alias("a"), F.col("target_id").alias("member"))
    held = checkpointed(held.join(called.hint("shuffle_hash"), "member").select("a", F.col("member").alias("b")).distinct())
    every = own.union(family.select("node")).union(held.select("a")).distinct()
    names = checkpointed(every.join(nodes.select("id", is_head.alias("head"), is_named.alias("named")), "id").join(family.toDF("id", "top"), "id", "left"))
    count, ids, size = names.agg(F.count("*"), F.count_distinct("id"), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()
    if count != ids or count > walks.MOST_NAMES or size > walks.MOST_BYTES:
        raise TooWide
    table = names.toArrow()
    texts = walks._text(table.column("id").combine_chunks())
    head, named = (table.column(c).to_numpy() for c in ("head", "named"))
    top = walks._text(table.column("top").combine_chunks())
    top = pc.if_else(pc.and_(pc.is_null(top), pa.array(head)), texts, top).dictionary_encode()
    group = pc.fill_null(top.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rooted = np.flatnonzero((group >= 0) & head & named)
    roots = _csr(group[rooted], rooted, len(top.dictionary))
    sc = spark.sparkContext
    sent = sc.broadcast(texts)
    at, to = _pairs(met.where("inner").select("source_id", "target_id").distinct(), sent, walks.MOST_INNER)
    inner = walks.Inner(at, to, np.zeros(len(at), np.int32), len(texts))
    holder, member = _pairs(held, sent, MOST_MEMBERS)
    some = (named & ~head)[holder] if len(holder) else holder.astype(bool)
    holders = _csr(member[some], holder[some], len(texts))
    sent = sc.broadcast((texts, inner, named & ~head, group, roots, holders))

    by_method, by_file = _by_name(nodes, tests, files)
    none = lambda t: F.lit(None).cast(t)
    mine = tests.select(F.col("id").alias("source_id"), none("string").alias("target_id"), F.col("is_method").cast("int").alias("kind"), "file", F.col("start_line").cast("int").alias("line"))
    said = met.where("test").select("source_id", "target_id", "kind").union(by_method.select("id", "root", F.lit(HINT))).select("*", none("int").alias("file"), none("int").alias("line"))
    rows = mine.union(said).repartition("source_id").sortWithinPartitions("source_id", F.col("target_id").isNotNull())
    out = {"heuristics": "root string, file int, method string"}.get(shape, f"root string, file int, {', '.join(f'{c} int' for c in COUNTS)}")
    out += ", first array<struct<line: int, method: string>>" if shape == "methods" else ""
    found = rows.mapInArrow(partial(_told, sent=sent, depth=depth, shape=shape), out)
    if shape != "heuristics":
        zero = [F.lit(int(c == "named")).alias(c) for c in COUNTS]
        found = found.union(by_file.select("root", "file", *zero, *([F.expr("cast(array() as array<struct<line: int, method: string>>)")] if shape == "methods" else [])))
    return found, files


def _by_name(nodes: DataFrame, tests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((root, id) of test methods that names speak for, (root, file) of files)."""
    named = evidence._named(nodes)
    methods = tests.where("is_method and kind = 'METHOD'")
    base = F.lower(F.regexp_extract("key", r"([^/]*)$", 1))
    number = F.col("file").cast("string").alias("id")
    texts = methods.select("id", F.lit(1).alias("how"), F.lower("name").alias("text")).union(methods.select("id", F.lit(2), F.lower("signature")))
    texts = texts.union(files.select(number, F.lit(3), base)).union(files.select(number, F.lit(4), F.regexp_replace(base, r"\.[^.]*$", "")))
    met = names_in(texts, named)
    of_file = lambda how: met.where(F.col("how") == how).select("root", F.col("id").cast("int").alias("file"))
    return met.where("how <= 2").select("root", "id").union(of_file(4).join(methods.select("id", "file"), "file").select("root", "id")), of_file(3).distinct()


def _whole(graph: Graph) -> Graph:
    return Graph(checkpointed(graph.nodes), checkpointed(graph.edges.distinct()))


#: Tags by what counts for their being there and for their methods.
TAGS = {
    "testImplementer": ("implementer", None),
    "testReference": ("reference + near", "near"),
    "indirectReference": ("far", "far"),
    "directCall": ("direct", "direct"),
    "potentialDispatch": ("dispatch", "dispatch"),
    "memberCall": ("member", "member"),
    "namingHeuristic": ("named", None),
    "heuristicMethod": ("heuristic", "heuristic"),
}


def _summed(found: DataFrame, *more: Column) -> DataFrame:
    return found.groupBy("root", "file").agg(*[F.sum(c).alias(c) for c in COUNTS], *more)


def by_file(graph: Graph) -> DataFrame:
    """(root, file, evidence, methods): how many test methods of a file speak for a root in each way."""
    try:
        found, files = told(graph.nodes, graph.edges, "counts")
    except TooWide:
        g = _whole(graph)
        return evidence.evidence(g.nodes, g.edges, g.nodes).groupBy("root", "file", "evidence").agg(F.count_distinct("method").alias("methods"))
    tags = [F.when(F.expr(there) > 0, F.struct(F.lit(tag).alias("evidence"), (F.col(n) if n else F.lit(0)).cast("long").alias("methods"))) for tag, (there, n) in TAGS.items()]
    out = _summed(found).join(F.broadcast(files.select("file", "path")), "file").select("root", F.col("path").alias("file"), F.explode(F.array_compact(F.array(*tags))).alias("x"))
    return out.select("root", "file", "x.*")


def summary(graph: Graph) -> DataFrame:
    """The rows of ``evidence.summary`` for all nodes."""
    try:
        found, _ = told(graph.nodes, graph.edges, "counts")
    except TooWide:
        g = _whole(graph)
        return evidence.summary(evidence.evidence(g.nodes, g.edges, g.nodes), g.nodes)
    n = _summed(found).groupBy("root").agg(F.max(F.col("direct") + F.col("member") > 0).alias("directly_tested"), F.sum("sources").alias("references"), F.sum("implementer").alias("implementers"), F.sum("heuristic").alias("heuristics"), F.count("*").alias("files"))
    return evidence.summed(n, graph.nodes)


def capped(graph: Graph, heuristic_nodes: int | None = None) -> DataFrame:
    """The rows of ``evidence.test_files`` for all nodes, names by ``heuristic_nodes`` as in ``evidence.naming``."""
    try:
        found, files = told(graph.nodes, graph.edges, "methods")
    except TooWide:
        g = _whole(graph)
        return evidence.test_files(evidence.evidence(g.nodes, g.edges, g.nodes, heuristic_nodes=heuristic_nodes), g.nodes)
    each = _summed(found, F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, evidence.METHODS).alias("first"))
    each = each.join(F.broadcast(files), "file")
    before = Window.partitionBy("root").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum(F.when(F.col("named") > 0, F.col("n"))).over(before), F.lit(0)))
    if heuristic_nodes is not None:
        each = each.withColumn("named", F.when(F.col("before") < heuristic_nodes, F.col("named")).otherwise(0))
    each = each.where("named + implementer + reference + near + far + direct + dispatch + member > 0")
    tags = F.array_sort(F.array_compact(F.array(*[F.when(F.expr(there) > 0, tag) for tag, (there, _) in TAGS.items() if tag != "heuristicMethod"])))
    of_root = Window.partitionBy("root")
    each = each.withColumn("file_place", F.row_number().over(of_root.orderBy(fold("path"), "path"))).withColumn("file_count", F.count("*").over(of_root)).where(F.col("file_place") <= evidence.FILES)
    return each.select("root", F.col("path").alias("file"), tags.alias("evidence"), F.col("methods").alias("test_count"), "file_place", "file_count", F.posexplode_outer("first").alias("at", "x")).select("root", "file", "evidence", "x.method", (F.col("at") + 1).alias("place"), "test_count", "file_place", "file_count")


def heuristics(graph: Graph) -> DataFrame:
    """(root, file, method) of the test methods that only names speak for."""
    try:
        found, files = told(graph.nodes, graph.edges, "heuristics")
    except TooWide:
        g = _whole(graph)
        return evidence.evidence(g.nodes, g.edges, g.nodes).where("evidence = 'heuristicMethod'").select("root", "file", "method")
    return found.join(F.broadcast(files.select("file", "path")), "file").select("root", F.col("path").alias("file"), "method")
