"""Small literal graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import expr as X
from weftgraph.operators import commit, evidence, files, resolve, traverse
from weftgraph.plans.adapter import Graph
from weftgraph.sources import ignore
from weftgraph.sources.snapshot import SnapshotStore
from weftgraph.streaming import changes

NODE = "id string, identifier string, name string, type string, file_path string, start_line int, end_line int, namespace string, signature string, is_test string, parser_id string, workspace_id string"
EDGE = "id string, source_id string, target_id string, type string, line bigint, parser_id string, workspace_id string"


def nodes(spark, rows, kind="Method"):
    """rows: id or (id, name, type, file)."""
    full = [(r, r, kind, f"/src/{r}.cs") if isinstance(r, str) else r for r in rows]
    return spark.createDataFrame([(i, f"x:{i}", n, t, p, 0, 9, None, n, None, "p", "w") for i, n, t, p in full], NODE)


def edges(spark, rows):
    """rows: (source, target, type[, line])."""
    return spark.createDataFrame([(f"e{k:02d}", *r[:3], r[3] if len(r) > 3 else None, "p", "w") for k, r in enumerate(rows)], EDGE)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cycle_and_paths(spark):
    n = nodes(spark, ["root", "one", "two", "three"])
    e = edges(spark, [("root", "one", "CALLS"), ("one", "two", "REFERENCES"), ("two", "three", "CALLS"), ("three", "one", "CALLS")])
    roots = n.where("id = 'root'")
    assert {(r.node, r.distance, tuple(r.relation_path)) for r in traverse.traverse(n, e, roots, 2, False).collect()} == {("one", 1, ("CALLS",)), ("two", 2, ("CALLS", "REFERENCES"))}
    assert traverse.traverse(n, e, roots, 3, False).count() == 3


@pytest.mark.parametrize("parts", [1, 5])
def test_path_winner(spark, parts):
    n = nodes(spark, ["goal", "left", "right", "far"])
    e = edges(spark, [("left", "goal", "CALLS"), ("right", "goal", "CALLS"), ("far", "left", "CALLS"), ("far", "right", "MOCK_CALLS")]).orderBy(F.rand(3)).repartition(parts)
    got = {r.node: r.relation_path for r in traverse.traverse(n, e, n.where("id = 'goal'"), 2, True).collect()}
    assert got["far"] == ["CALLS", "CALLS"]


def test_method_family(spark):
    n = nodes(spark, ["port", "disk", "memory", "reader", "writer", "both", "outer", "lock", "heap"])
    e = edges(spark, [("disk", "port", "IMPLEMENTS_MEMBER"), ("memory", "port", "implements_member"), ("reader", "port", "CALLS", 3), ("reader", "port", "CALLS", 4), ("writer", "disk", "CALLS", 5), ("both", "port", "CALLS", 6), ("both", "memory", "CALLS", 7), ("outer", "writer", "CALLS", 8), ("disk", "lock", "CALLS", 9), ("memory", "heap", "CALLS", 10)])
    root = n.where("id = 'disk'")
    assert rows(traverse.method_family(n, e, root)) == [("disk", x) for x in ("disk", "memory", "port")]
    assert [r.node for r in traverse.family_order(n, e, root).orderBy("ord").collect()] == ["disk", "port", "memory"]
    assert {r.node for r in traverse.traverse(n, e, root, 1, False).collect()} == {"lock"}
    want = {("reader", 1), ("writer", 1), ("both", 1), ("outer", 2)}
    assert {(r.node, r.distance) for r in traverse.family_used_by(n, e, root, 2).collect()} == want
    assert {(r.node, r.distance) for r in traverse.family_reach(n, e, root, 2).collect()} == want
    assert {r.caller: r.bindings for r in traverse.bindings(n, e, root).collect()} == {"reader": ["interface"], "writer": ["exact"], "both": ["implementation", "interface"]}
    assert {r.node for r in traverse.statically_bound_targets(n, e, root).collect()} == {"port", "disk", "memory"}
    assert [r.node for r in traverse.in_order(traverse.family_reach(n, e, root, 2), n).orderBy("place").collect()] == ["both", "reader", "writer", "outer"]


def test_components_of_long_chains(spark):
    from weftgraph.operators.components import components

    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("z2", "z1"), ("z3", "z3")], "a string, b string")
    got = {r.node: r.head for r in components(links).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(71)} | {"z1": "z1", "z2": "z1"}


def test_file_dependencies(spark):
    n = nodes(spark, [("a", "a", "Class", "src/A.cs"), ("b", "b", "Class", "src/B.cs"), ("b2", "b2", "Class", "src/b.cs"), ("c", "c", "Class", "src/C.cs")])
    e = edges(spark, [("a", "b", "CALLS"), ("a", "b2", "IMPORTS"), ("a", "c", "FUTURE_KIND"), ("a", "c", None), ("a", "c", "HAS_METHOD"), ("a", "gone", "CALLS")])
    assert rows(files.file_dependencies(n, e)) == [("src/A.cs", "src/B.cs")]


def test_paths(spark):
    n = nodes(spark, [("n1", "n1", "Class", "/repo/src/Foo.cs"), ("n2", "n2", "Class", "/repo/src/Bar.cs"), ("n3", "n3", "Class", "/repo/tests/Foo.cs")])
    ids = lambda p: {r.id for r in resolve.nodes_by_path(n, p).collect()}
    assert ids("/REPO/SRC/FOO.CS") == {"n1"} and ids("Foo.cs") == {"n1", "n3"} and ids("src/Foo.cs") == {"n1"} and ids("ar.cs") == set()


def test_relation_filter():
    assert resolve.relation_kinds(" calls, ,USES") == ["CALLS", "USES"] and resolve.relation_kinds(" , ") is None
    with pytest.raises(ValueError, match="unknown relation NOPE"):
        resolve.relation_kinds("CALLS,nope")


def test_evidence(spark):
    n = nodes(spark, [("cls", "Widget", "Class", "/src/W.cs"), ("m1", "Go", "Method", "/src/W.cs"), ("t1", "TestGo", "Method", "/tests/T.cs"), ("h", "Helper", "Method", "/tests/H.cs"), ("t2", "TestOther", "Method", "/tests/T2.cs"), ("a", "A", "Method", "/src/A.cs")])
    e = edges(spark, [("cls", "m1", "HAS_METHOD"), ("t1", "m1", "CALLS"), ("h", "m1", "CALLS"), ("t2", "a", "CALLS"), ("a", "cls", "REFERENCES")])
    found = evidence.evidence(n, e, n.where("id in ('cls', 'm1')"))
    got = {(r.root, r.evidence, r.method) for r in found.collect()}
    assert ("cls", "memberCall", "t1") in got and ("cls", "indirectReference", "t2") in got and ("m1", "directCall", "t1") in got
    assert not any(x == ("cls", "memberCall", "h") for x in got)
    s = {r.root: r for r in evidence.summary(found, n.where("id in ('cls', 'm1')")).collect()}
    assert s["cls"].directly_tested and s["cls"].references == 1 and s["m1"].is_tested and s["m1"].references == 2  # t1 and the helper


def test_evidence_by_member_alone_and_by_name(spark):
    n = nodes(spark, [("cls", "Widget", "Class", "/src/W.cs"), ("m1", "Go", "Method", "/src/W.cs"), ("t1", "TestIt", "Method", "/tests/T.cs"), ("gear", "Gear", "Class", "/src/G.cs"), ("t2", "TestTurns", "Method", "/tests/GearTests.cs"), ("t3", "Helps", "Method", "/tests/GearTests.cs"), ("get", "GetCog", "Method", "/src/C.cs"), ("t4", "TestCogTurns", "Method", "/spec/Other.cs")])
    e = edges(spark, [("cls", "m1", "HAS_METHOD"), ("t1", "m1", "MOCK_CALLS")])
    found = evidence.evidence(n, e, n.where("file_path like '/src/%'"))
    s = {r.root: r for r in evidence.summary(found, n.where("file_path like '/src/%'")).collect()}
    assert s["cls"].directly_tested and s["cls"].references == 0 and s["cls"].heuristics == 0
    assert s["gear"].is_tested and not s["gear"].directly_tested and s["gear"].heuristics == 1  # by the file's name: its test methods
    assert s["get"].heuristics == 1  # "test" + "cog"
    tags = {(r.root, r.evidence, r.method) for r in found.collect()}
    assert ("gear", "namingHeuristic", None) in tags and ("gear", "heuristicMethod", "t2") in tags and ("get", "heuristicMethod", "t4") in tags
    dispatch = edges(spark, [("impl", "api", "IMPLEMENTS_MEMBER"), ("t", "api", "CALLS"), ("fake", "svc", "IMPLEMENTS")])
    m = nodes(spark, [("api", "Api", "Method", "/src/A.cs"), ("impl", "Impl", "Method", "/src/A.cs"), ("t", "TestX", "Method", "/tests/X.cs"), ("svc", "Svc", "Interface", "/src/S.cs"), ("fake", "Fake", "Class", "/TESTS/x.cs")])
    got = {(r.root, r.evidence, r.file) for r in evidence.evidence(m, dispatch, m.where("file_path like '/src/%'")).collect()}
    assert ("impl", "potentialDispatch", "/TESTS/x.cs") in got and ("api", "directCall", "/TESTS/x.cs") in got and ("svc", "testImplementer", "/TESTS/x.cs") in got


@pytest.mark.parametrize("members,want", [(200, 200), (None, 201)])
def test_members_probed(spark, members, want):
    n = nodes(spark, [("cls", "Wide", "Class", "/src/W.cs"), *[(f"m{i:03d}", f"M{i}", "Method", "/src/W.cs") for i in range(201)], *[(f"t{i:03d}", f"TestNumber{i}", "Method", f"/tests/T{i:03d}.cs") for i in range(201)]])
    e = spark.createDataFrame([(f"h{i:03d}", "cls", f"m{i:03d}", "HAS_METHOD", None, "p", "w") for i in range(201)] + [(f"c{i:03d}", f"t{i:03d}", f"m{i:03d}", "CALLS", None, "p", "w") for i in range(201)], EDGE)
    tests = evidence.test_symbols(n)
    found = evidence.graph_evidence(n, e, n.where("id = 'cls'"), tests, members=members)
    assert found.where("evidence = 'memberCall'").select("method").distinct().count() == want


def test_commit_scoped(spark):
    n = nodes(spark, ["a", "b"]).union(nodes(spark, ["f"]).withColumn("parser_id", F.lit("q")))
    e = edges(spark, [("a", "b", "CALLS")]).union(edges(spark, [("f", "a", "CALLS"), ("f", "b", "CALLS")]).withColumn("id", F.concat(F.lit("f"), "id")).withColumn("parser_id", F.lit("q")))
    delta = Graph(nodes(spark, ["a"]), edges(spark, []))
    after = commit.commit_scoped(Graph(n, e), delta, "p", "w")
    assert {r.id for r in after.nodes.collect()} == {"a", "f"}
    assert {r.id for r in after.edges.collect()} == {"fe00"}


IGNORED = [
    # rules by folder, path, included
    ({"": "dist/\n"}, "dist/app.js", False),
    ({"": "dist/\n"}, "pkg/dist/deep/app.js", False),
    ({"": "dist/\n"}, "dist", True),  # a file of that name
    ({"": "/top.txt\n"}, "top.txt", False),
    ({"": "/top.txt\n"}, "sub/top.txt", True),
    ({"": "*.log\n!keep.log\n"}, "a/b/x.log", False),
    ({"": "*.log\n!keep.log\n"}, "a/b/keep.log", True),
    ({"": "vendor/\n!vendor/mine.c\n"}, "vendor/mine.c", False),  # nothing returns from a folder that is out
    ({"": "lib/*\n", "lib": "!own.c\n"}, "lib/own.c", True),
    ({"": "lib/*\n", "lib": "!own.c\n"}, "lib/other.c", False),
    ({"": "\\#notes\n\\!wow\n"}, "#notes", False),
    ({"": "\\#notes\n\\!wow\n"}, "!wow", False),
    ({"": "#notes\n"}, "#notes", True),
    ({"": "two\\ words   \n"}, "two words", False),
    ({"": "a/**/z\n"}, "a/b/c/z", False),
    ({"": "a/**/z\n"}, "q/a/z", True),
    ({"": "v?.[!c]\n"}, "v1.o", False),
    ({"": "v?.[!c]\n"}, "v1.c", True),
    ({}, ".git/config", False),
    ({"a": "x\n"}, "b/x", True),
]


@pytest.mark.parametrize("files,path,included", IGNORED)
def test_ignore(spark, files, path, included):
    rules = ignore.compile_rules(spark, list(files.items()))
    assert ignore.ignore_filter(spark.createDataFrame([(path,)], "path string"), rules).first().included is included


def test_scan_files_and_rules(spark, tmp_path):
    for name in ("a.cs", "sub/b.CS", "sub/c.md", "out/d.cs"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = ignore.included_files(spark, str(tmp_path), ("cs",), ignore.compile_rules(spark, [("", "out/\n")]))
    assert sorted(r.path for r in found.collect()) == ["a.cs", "sub/b.CS"]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    one = Graph(nodes(spark, ["a"]), edges(spark, []))
    assert store.publish(one, 0) == 1
    held = store.read()
    assert store.publish(Graph(nodes(spark, ["a", "b"]), edges(spark, []))) == 2
    assert held.nodes.count() == 1 and store.read().nodes.count() == 2
    with pytest.raises(RuntimeError):
        store.publish(one, 1)
    store.clear()
    assert store.version() == 0


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    store, late = SnapshotStore(spark, str(tmp_path / "store")), SnapshotStore(spark, str(tmp_path / "store"))
    monkeypatch.setattr(late, "version", lambda: 0)  # it looked before the other published
    store.publish(Graph(nodes(spark, ["a"]), edges(spark, [])))
    with pytest.raises(RuntimeError, match="another writer"):
        late.publish(Graph(nodes(spark, ["b"]), edges(spark, [])))
    assert [r.id for r in store.read().nodes.collect()] == ["a"]
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("data-")]) == 1


def test_commits_dedupe_and_check(spark):
    n = nodes(spark, ["a", "b"])
    twice = n.where("id = 'a'").withColumn("name", F.lit("zz")).union(n)
    after = commit.commit_full(Graph(twice, edges(spark, [])))
    assert rows(after.nodes.select("id", "name")) == [("a", "zz"), ("b", "b")]
    ordered = twice.withColumn("ord", F.when(F.col("name") == "zz", 1).otherwise(2))
    assert rows(commit.commit_full(Graph(ordered, edges(spark, []))).nodes.select("id", "name")) == [("a", "a"), ("b", "b")]
    with pytest.raises(ValueError, match="x:a"):
        commit.commit_full(Graph(n.withColumn("identifier", F.lit("x:a")), edges(spark, [])))
    g = Graph(n, edges(spark, []))
    assert commit.commit_newer(g, Graph(nodes(spark, ["c"]), edges(spark, [])), "p", "w", 3, 3) is g


def test_reconciliation(spark):
    from weftgraph.operators.lifecycle import Reconciliation

    g, seen = Graph(nodes(spark, ["a"]), edges(spark, [])), []

    def publish(x):
        seen.append({r.id for r in x.nodes.collect()})
        return len(seen)

    with Reconciliation(g, publish) as r:
        assert r.commit(Graph(nodes(spark, ["b", "c"]), edges(spark, [])), "p", "w", 1) and not r.commit(g, "p", "w", 1)
        r.prune(nodes(spark, ["b"]).select("file_path"))
        with pytest.raises(RuntimeError, match="open already"), Reconciliation(g, publish):
            pass
        assert r.publish() == 1
    with pytest.raises(KeyError), Reconciliation(g, publish) as r:
        r.commit(Graph(nodes(spark, ["d"]), edges(spark, [])), "p", "w", 1)
        raise KeyError
    assert seen == [{"b"}] and r.graph is g


def test_scan_state_and_progress():
    from weftgraph.operators.lifecycle import ScanState, progress

    s = ScanState()
    assert s.begin() == 1 and s.begin() is None
    s.fail("disk")
    s.complete()
    assert s.state == "Error" and s.begin() == 2 and s.error is None
    s.complete()
    assert s.state == "Ready"
    told, last = [], -1
    for i in range(1, 1001):
        if (p := progress(i, 1000, last)) is not None:
            told.append(p)
            last = p
    assert told == list(range(10, 1001, 10)) and progress(5, 1000, 10) is None and progress(1, 1) == 1


def test_extractors(spark):
    import pandas as pd

    from weftgraph.sources import facts

    def words(frames):
        for f in frames:
            w = [(f"n:{p}:{x}", x, p) for p, t in zip(f["path"], f["text"]) for x in t.split()]
            yield pd.DataFrame({"kind": "node", "id": [i for i, _, _ in w], "identifier": [i for i, _, _ in w], "name": [x for _, x, _ in w], "type": "Class", "file_path": [p for *_, p in w], "start_line": 0, "end_line": 0, "source_id": None, "target_id": None})

    def broken(frames):
        raise ValueError("no grammar")
        yield

    own = facts.Registry([facts.FactExtractor("w", (".txt",), words), facts.FactExtractor("bad", ("bad", "txt"), broken)])
    files = spark.createDataFrame([("/a.txt", "one two"), ("/b.bad", "x"), ("/c.none", "y")], "path string, text string")
    found, failures = own.full_scan(files)
    assert rows(found.select("name", "parser_id")) == [("one", "w"), ("two", "w")] and len(failures) == 1
    assert facts.first_claims(own.extractors) == {"txt": "w", "bad": "bad"}
    d = spark.createDataFrame([("/x/a.cs", "x/A.cs"), ("/x/a.cs", "a.cs"), ("/x/ba.cs", "a.cs"), ("a.cs", "/q/a.cs")], "a string, b string")
    assert [r[0] for r in d.select(facts.same_file("a", "b")).collect()] == [True, True, False, True]


def test_options_and_requests(spark):
    from weftgraph.operators import context

    for bad in ({"depth": 11}, {"max_matches": 0}, {"max_relationships": 101}, {"max_test_files": -1}, {"relation": "NOPE"}, {"full": True, "relation": "CALLS"}):
        with pytest.raises(ValueError):
            context.Options(**bad)
    assert context.Options(full=True, max_matches=0).full
    with pytest.raises(ValueError, match="blank"):
        context.check_requests(["a", " "])
    n = nodes(spark, [("a", "Alpha", "Class", "/r/a.cs"), ("b", "Beta", "Class", "/r/b.cs"), ("c", "Gamma", "Class", "/r/c.cs"), ("d", "Delta", "Class", "/r/d.cs")]).withColumn("start_col", F.lit(0))
    e = edges(spark, [("b", "a", "CALLS", 4), ("b", "a", "CALLS", 9), ("c", "a", "REFERENCES"), ("d", "c", "CALLS")])
    asked = spark.createDataFrame([(1, "Alpha"), (2, "zeta"), (3, "r/b.cs")], "req int, query string")
    got = context.compact_context(Graph(n, e), asked, context.Options(depth=2, max_relationships=1, root_path="/r"))
    assert [x.line for x in context.agent_lines(got, asked).orderBy("req", "ord").collect()] == [
        "target\tx:a\tClass\ta.cs:1\tAlpha",
        "usedBy\t1/2\ttruncated",
        "\tCALLS\tBeta\tClass\tb.cs:1",
        "transitiveUsedBy\t1/1",
        "\t-\tDelta\tClass\td.cs:1",
        "fileDependents\t1/2\ttruncated",
        "\tb.cs",
        "missing\tzeta",
        "matches\t1/1\tfilePath",
        "target\tx:b\tClass\tb.cs:1\tBeta",
        "uses\t1/1",
        "\tCALLS\tAlpha\tClass\ta.cs:1",
        "fileDependencies\t1/1",
        "\ta.cs",
    ]
    none = context.compact_context(Graph(n, e), asked.where("req = 1"), context.Options(relation="INHERITS", root_path="/r")).relationships
    assert [(r.section, r.total, r.node) for r in none.where("section = 'usedBy'").collect()] == [("usedBy", 0, None)]


def test_batches_are_those_of_one_pass(spark):
    import random

    rng = random.Random(6)
    for gap, cap, spread in ((5, 20, 4), (5, 20, 9), (3, 3, 2), (10, 1000, 3)):
        t, times = 0, []
        for _ in range(400):
            t += rng.randrange(spread + 1)
            times.append(t)
        want, start, last = {}, None, None
        for x in times:
            if start is None or x - last > gap or x > start + cap:
                start = x
            last = want[x] = x
            want[x] = start
        rows_ = spark.createDataFrame([(i, x) for i, x in enumerate(times)], "seq bigint, us bigint").select("seq", F.timestamp_micros("us").alias("ts"), "us")
        got = {r.us: r.batch for r in changes.micro_batch(rows_, gap, cap).collect()}
        assert got == want
    assert changes.micro_batch(rows_.limit(0), 1, 1).count() == 0


def test_change_fold(spark):
    kinds = spark.createDataFrame([(["created", "changed"],), (["deleted", "created"],), (["created", "deleted"],), (["changed"],)], "k array<string>")
    assert [r[0] for r in kinds.select(changes.fold_changes(F.col("k"))).collect()] == ["created", "changed", "deleted", "changed"]


def test_stream(spark, tmp_path):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", "created", None), (2, "2024-01-01 00:00:01", "b", "renamed", "a")], "seq bigint, ts string, path string, change_type string, old_path string").withColumn("ts", F.col("ts").cast("timestamp"))
    log.coalesce(1).write.json(str(tmp_path / "log"))
    got = []
    q = changes.follow(spark.readStream.schema(log.schema).json(str(tmp_path / "log")), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.path, r.change_type) for r in got} == {("a", "deleted"), ("b", "changed")}


def test_expressions(spark):
    df = spark.createDataFrame([("csharp:w:Ns.Type#Ns.Outer.Run(int)", "", "a  b\n c")], "id string, identifier string, signature string")
    r = df.select(X.legacy_identifier(), X.containing_type("id"), X.compact_signature()).first()
    assert tuple(r) == ("Ns.Type#Ns.Outer.Run(int)", "Outer", "a b c")


def test_ignore_filter_judges_long_paths_whole(spark):
    from weftgraph.plans import queries

    path = "/wh/" + "d/" * 600 + "a.ts"
    g = Graph(spark.createDataFrame([(path,)], "file_path string"), None)
    assert [tuple(r) for r in queries.ignore_filter(g).collect()] == [(path, False)]


def test_family_used_by_deep(spark):
    from weftgraph.plans import queries

    kinds = [("b", "a", "OVERRIDES_MEMBER"), ("c", "b", "CALLS"), ("d", "c", "CALLS"), ("e", "d", "CALLS"), ("f", "e", "CALLS")]
    edges = [(f"{s}>{t}", s, t, k, None, None) for s, t, k in kinds]
    g = Graph(spark.createDataFrame([(x, "Method" if x in "ab" else "Class") for x in "abcdef"], "id string, type string"), spark.createDataFrame(edges, "id string, source_id string, target_id string, type string, line bigint, col bigint"))
    got = sorted((r.root, r.node, r.distance) for r in queries.family_used_by_deep(g).collect())
    assert got == [(root, node, n) for root in "ab" for n, node in enumerate("cde", 1)]
