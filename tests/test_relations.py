"""Relationships of all nodes at once, against those of roots level by level."""

import random

import pytest

from weftgraph.operators import context, relations, walks
from weftgraph.plans.adapter import Graph


def rows(df):
    assert df.columns == ["root", "section", "node", "distance"]
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def graph(spark):
    """Families in chains and with callers among their members, loops, parallel and equal edges, ends that are no nodes,
    types null and odd, ids null and empty, files whose paths differ by case, nodes told twice."""
    r = random.Random(7)
    names = [f"n{i}" for i in range(50)] + ["é", "", "lone"]
    paths = ["/a.cs", "/A.cs", "/b.cs", "/c/d.cs", "\\c\\d.cs", "/e.cs/", "", None]
    node = [(n, r.choice(["Method", "method", "Class", None]), r.choice(paths), r.choice(["x", None])) for n in names]
    edge = []
    for i in range(170):
        a, b, kind = r.choice(names), r.choice(names[:30]), r.choice(["CALLS", "calls", None, "USES", "HAS_METHOD", "IMPLEMENTS"])
        edge.append((r.choice([f"e{i}", f"e{i % 60}", None]), a, b, kind))
    edge += [(f"k{i}", f"n{i}", f"n{i + 1}", r.choice(["OVERRIDES_MEMBER", "implements_member"])) for i in range(20, 46) if i % 7]
    edge += [("x", "n1", "no node", "CALLS"), ("y", "no node", "n2", "CALLS"), ("z", None, "n2", "CALLS"), ("l", "n3", "n3", "CALLS")]
    nodes = spark.createDataFrame(node + node[:5] + [(None, "Method", "/a.cs", "x")], "id string, type string, file_path string, namespace string")
    edges = spark.createDataFrame(edge + edge[:40], "id string, source_id string, target_id string, type string")
    return Graph(nodes, edges)


@pytest.mark.parametrize("depth", [1, 3])
def test_as_from_roots(graph, monkeypatch, depth):
    want = rows(context.build_relationships(graph, graph.nodes, depth))
    assert {r[1] for r in want} >= {"uses", "usedBy", "fileDependencies", "fileDependents"} and len(want) > 300
    monkeypatch.setattr(relations, "_rest", None)
    spread = Graph(graph.nodes.repartition(5), graph.edges.repartition(7))
    assert rows(relations.of_all(spread, depth)) == want
    monkeypatch.setattr(relations, "FEW", 12)  # families by steps
    monkeypatch.setattr(relations, "MOST_LINKS", 3)
    monkeypatch.setattr(walks, "EDGES", 9)
    assert rows(relations.of_all(spread, depth)) == want


def test_families_of_called_members(spark):
    kin = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("f", "g")], "a string, b string")
    called = spark.createDataFrame([("c",), ("x",)], "node string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(relations, "FEW", 2)
        assert sorted(map(tuple, relations._kin_of(kin, called).collect())) == [("a", "b"), ("c", "b")]
        m.setattr(relations, "STEPS", 1)
        assert relations._kin_of(kin, called).count() == 4


@pytest.mark.parametrize("limit", [(walks, "MOST_NAMES"), (walks, "MOST_INNER"), (relations, "MOST_FILES")])
def test_too_much_to_send(graph, monkeypatch, limit):
    monkeypatch.setattr(*limit, 2)
    seen = []
    monkeypatch.setattr(relations, "_rest", lambda *x: seen.append(x))
    relations.of_all(graph, 2)
    assert len(seen) == 1


def test_nodes_that_share_an_id(spark, graph):
    more = graph.nodes.union(spark.createDataFrame([("n4", "Class", "/other.cs", "x"), ("n4", "Method", "/b.cs", "y")], graph.nodes.schema))
    both = Graph(more, graph.edges)
    assert rows(relations.of_all(both, 2)) == rows(context.build_relationships(both, more, 2))


def test_no_edges_no_files(spark):
    nodes = spark.createDataFrame([("a", "Method", None, None)], "id string, type string, file_path string, namespace string")
    edges = spark.createDataFrame([], "id string, source_id string, target_id string, type string")
    assert rows(relations.of_all(Graph(nodes, edges), 2)) == []
    assert rows(relations.of_all(Graph(nodes.limit(0), edges), 2)) == []
