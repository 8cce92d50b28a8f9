"""Streams with state against the batch forms of the same rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import commit
from weftgraph.sources.facts import DELTA
from weftgraph.streaming import changes, state

GAP, CAP = 500_000, 2_000_000
LOG = "seq bigint, ts timestamp, path string, change_type string, watch string"


def plain(times, gap, cap):
    """The first time of each time's batch, one by one."""
    out, first, last = {}, None, None
    for t in sorted(times):
        if first is None or t - last > gap or t - first > cap:
            first = t
        out[t], last = first, t
    return out


def test_closed_batches_in_any_cut_of_time():
    rnd = random.Random(3)
    for _ in range(300):
        times = sorted(rnd.randrange(60) for _ in range(rnd.randrange(1, 25)))
        want = plain(times, 3, 9)
        pending, got, left = [], {}, times
        for settled in sorted(rnd.sample(range(60), 6)) + [100]:
            # Rows beyond the watermark may come early, those up to it must have come.
            early = {t for t in left if t > settled and rnd.random() < 0.3}
            pending = sorted(pending + [[t] for t in left if t <= settled or t in early])
            left = [t for t in left if t > settled and t not in early]
            out, pending = state.closed(pending, settled, 3, 9)
            for first, t in out:
                assert got.setdefault(t, first) == first
        assert got == want and not pending


def test_closed_of_nothing():
    assert state.closed([], 10, 1, 1) == ([], [])


@pytest.mark.parametrize("keys", [(), ("watch",)])
def test_capped_batches_equal_micro_batch(spark, tmp_path, keys):
    rnd = random.Random(5)
    rows, t = [], 1_700_000_000_000_000
    for i in range(120):
        t += rnd.choice([100_000, 300_000, 700_000, 4_000_000])
        rows.append((i, t, f"f{rnd.randrange(4)}", rnd.choice(["created", "changed", "deleted"]), f"w{rnd.randrange(2)}"))
    closing = [(900 + i, t + 3_600_000_000, "end", "changed", f"w{i}") for i in range(2)]
    (tmp_path / "log").mkdir()
    out = []
    for n, part in enumerate([rows[:40], rows[40:41], rows[41:120], closing, []]):
        line = lambda r: json.dumps({"seq": r[0], "ts": f"{r[1] // 1_000_000}.{r[1] % 1_000_000:06d}", "path": r[2], "change_type": r[3], "watch": r[4]})
        (tmp_path / "log" / f"{n}.json").write_text("\n".join(map(line, part)) + "\n")
        source = spark.readStream.schema(LOG.replace("ts timestamp", "ts string")).json(str(tmp_path / "log"))
        source = source.withColumn("ts", F.timestamp_micros((F.col("ts").cast("decimal(20,6)") * 1_000_000).cast("bigint")))
        q = state.follow_batches(state.capped_batches(source, GAP, CAP, "1 second", keys), lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "cp"), keys)
        q.awaitTermination(90)
        assert q.exception() is None
    table = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in rows], "seq bigint, us bigint, path string, change_type string, watch string").withColumn("ts", F.timestamp_micros("us"))
    want = []
    for w in ["w0", "w1"] if keys else [None]:
        own = table if w is None else table.where(F.col("watch") == w)
        named = plain([r.us for r in own.collect()], GAP, CAP)
        batched = own.withColumn("batch", F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("us")])
        assert {(r._us, r.batch) for r in changes.micro_batch(own.drop("us"), GAP, CAP).withColumn("_us", F.unix_micros("ts")).collect()} == set(named.items())
        want += [(*([w] if w else []), *r) for r in changes.coalesce_changes(batched).collect()]
    assert sorted(r for r in out if "end" not in r) == sorted(want)


def chunk(generation, request, number, last, parser="p"):
    nodes = [{"id": f"{parser}:w:{generation}/{request}/{number}"}]
    return {"parser_id": parser, "workspace_id": "w", "generation": generation, "request_id": request, "chunk_ord": number, "replaces_workspace": False, "replaces_files": [], "nodes": nodes, "edges": [], "is_last_for_request": last}


def test_advance():
    s, whole = state.advance({}, [(1, 7, 1, True), (1, 7, 1, True)])
    assert whole == []  # the first chunk is missing
    s, whole = state.advance(s, [(1, 7, 0, False), (1, 7, 0, False)])
    assert whole == [(1, 7)]
    assert state.advance(s, [(1, 7, 0, False), (1, 7, 1, True)])[1] == []  # once only
    s, whole = state.advance(s, [(3, 9, 0, False), (2, 8, 0, True)])
    assert whole == []  # an unfinished newer generation discards older ones
    assert state.advance(s, [(3, 9, 1, True)])[1] == [(3, 9)]
    assert state.advance({}, [(1, 1, 0, True), (2, 1, 0, False)])[1] == []


def test_whole_deltas_equal_assembled_rows(spark, tmp_path):
    files = [
        [chunk(1, 1, 0, False), chunk(1, 1, 1, False), chunk(4, 1, 0, False, "q")],
        [chunk(1, 1, 2, True), chunk(2, 2, 0, True, "r")],
        [chunk(1, 1, 0, True, "r"), chunk(5, 2, 0, False, "p")],
        [chunk(4, 1, 1, True, "q"), chunk(1, 1, 2, True)],
    ]
    (tmp_path / "log").mkdir()
    got = []
    table = lambda: spark.read.schema(DELTA).json(str(tmp_path / "log"))
    for n, part in enumerate(files):
        (tmp_path / "log" / f"{n}.json").write_text("\n".join(map(json.dumps, part)) + "\n")
        q = state.follow_deltas(spark.readStream.schema(DELTA).json(str(tmp_path / "log")), table, lambda df, _: got.append(sorted((r.parser_id, r.generation, r.chunk_ord) for r in df.collect())), str(tmp_path / "cp"))
        q.awaitTermination(90)
        assert q.exception() is None
    assert got == [[("p", 1, 0), ("p", 1, 1), ("p", 1, 2), ("r", 2, 0)], [("q", 4, 0), ("q", 4, 1)]]
    assert {(r.parser_id, r.generation) for r in commit.assemble_rows(table()).collect()} == {("q", 4), ("r", 2)}  # p's generation 5 is open


def test_chunks_across_files(spark):
    """Chunks of a shard whose facts lie in many small files, equal facts told once: every fact once, in order, whole
    chunks but the last; ends that are no part of the id, and null ones, come back as they were."""
    from weftgraph.plans.adapter import Graph
    from weftgraph.sources import facts

    node = [("p", "w", f"n{i:03d}", f"i{i}", "x", "Class", "/a.cs", 1, 2, 0, "s", "g", "false") for i in range(25)]
    names = [x.split(":")[0] for x in facts.NODE[7:-1].split(",")]
    nodes = spark.createDataFrame(node, "parser_id string, workspace_id string, " + facts.NODE[7:-1])
    edge = [("p", "w", f"n{i:03d}=[A]=>t{i}", f"n{i:03d}", f"t{i}" if i % 3 else "elsewhere", None if i % 5 == 0 else "A", i, None) for i in range(50)]
    edge += [("q", "w", "only", "", "é", "B", None, 1), ("p", "w", None, "n001", "x" * 2000, None, 1, 1)]
    edges = spark.createDataFrame(edge + edge[:20], "parser_id string, workspace_id string, " + facts.EDGE[7:-1])
    got = facts.delta_chunks(Graph(nodes, edges.repartition(3)), 1, 1, size=7, rows=4).orderBy("parser_id", "chunk_ord").collect()
    own = [r for r in got if r.parser_id == "p"]
    assert [r.chunk_ord for r in own] == list(range(4 + 8)) and [r.is_last_for_request for r in own] == [False] * 11 + [True]
    assert [len(r.nodes) for r in own][:4] == [7, 7, 7, 4] and [len(r.edges) for r in own][4:] == [7] * 7 + [2]
    assert [x.id for r in own for x in r.nodes] == [x[2] for x in node] and list(own[0].nodes[0].asDict()) == names
    want = sorted((x[2:] for x in edge if x[0] == "p"), key=lambda x: (x[0] is None, x[0]))
    assert [tuple(x) for r in own for x in r.edges] == want
    assert [tuple(x) for r in got if r.parser_id == "q" for x in r.edges] == [edge[50][2:]]
