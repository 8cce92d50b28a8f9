"""Walks from all nodes in arrays, against the joins level by level."""

import random

import pytest

from weftgraph.operators import traverse, walks


def rows(df):
    return sorted((r.root, r.node, r.distance, tuple(r.relation_path)) for r in df.collect())


@pytest.fixture(scope="module")
def graph(spark):
    """Cycles, loops, parallel and equal edges, a hub, types null and odd, ends that are no nodes, ids null or without the ends."""
    r = random.Random(5)
    names = [f"n{i}" for i in range(40)] + ["é", "", "lone"]
    edge = []
    for i in range(160):
        a, b, kind = r.choice(names), r.choice(names[:25]), r.choice(["CALLS", "calls", None, "USES", "HAS_METHOD", "REFERENCES"])
        edge.append((r.choice([f"{a}=[{kind}]=>{b}@{i}", f"e{i % 60}", None]), a, b, kind))
    edge += [("h" + str(i), "n1", f"n{i}", "CALLS") for i in range(30)] + [("x", "n1", "no node", "CALLS"), ("y", "no node", "n2", "CALLS"), ("z", None, "n2", "CALLS")]
    nodes = spark.createDataFrame([(n,) for n in names] + [(None,)], "id string")
    return nodes, spark.createDataFrame(edge + edge[:40], "id string, source_id string, target_id string, type string")


@pytest.mark.parametrize("incoming", [False, True])
@pytest.mark.parametrize("depth", [1, 3, 5])
def test_as_by_levels(graph, monkeypatch, depth, incoming):
    nodes, edges = graph
    want = rows(traverse.traverse(nodes, edges.distinct(), nodes.where("id is not null"), depth, incoming))
    assert len(want) > 100
    monkeypatch.setattr(traverse, "traverse", None)
    assert rows(walks.traverse_all(nodes, edges.repartition(7), depth, incoming)) == want


@pytest.mark.parametrize("incoming", [False, True])
def test_in_parts(graph, monkeypatch, incoming):
    """Batches smaller than a source's edges, candidates in halves, keys too wide for one number."""
    import numpy as np
    import pyarrow as pa

    nodes, edges = graph
    want = rows(traverse.traverse(nodes, edges.distinct(), nodes.where("id is not null"), 3, incoming))
    usage = [r for r in edges.where("type is null or type <> 'HAS_METHOD'").distinct().collect() if r.source_id is not None]
    ids = {r.id for r in nodes.collect()} - {None}
    order = lambda r: (r.id or "", r.source_id, r.target_id, r.type or "")
    names, kinds = pa.array(sorted({r.target_id for r in usage} & ids)), pa.array(sorted({r.type or "USES" for r in usage}))
    at = {n: i for i, n in enumerate(names.to_pylist())}
    deep = [r for r in sorted(usage, key=order) if r.source_id in at and r.target_id in at]
    inner = walks.Inner(np.array([at[r.source_id] for r in deep]), np.array([at[r.target_id] for r in deep]), np.array([kinds.to_pylist().index(r.type or "USES") for r in deep]), len(names))
    met = sorted([(n, 0, "", None, "", None) for n in ids] + [(r.source_id, 1, r.id or "", r.target_id, r.type or "", r.type or "USES") for r in usage], key=lambda r: (r[0], r[1], r[2], r[3] or "", r[4]))
    table = pa.table({"source_id": [r[0] for r in met], "target_id": pa.array([r[3] for r in met], pa.string()), "shown": pa.array([r[5] for r in met], pa.string())})
    monkeypatch.setattr(walks, "EDGES", 5)
    monkeypatch.setattr(walks, "CANDIDATES", 20)
    monkeypatch.setattr(walks, "ROWS", 3)
    sent = type("Sent", (), {"value": (names, kinds, inner)})
    got = [r for b in walks._walk(iter(table.to_batches(max_chunksize=4)), sent, 3, incoming, True) for r in b.to_pylist()]
    assert sorted((r["root"], r["node"], r["distance"], tuple(r["relation_path"])) for r in got) == want


def test_too_much_to_send(graph, monkeypatch):
    nodes, edges = graph
    want = rows(walks.traverse_all(nodes, edges, 2, True))
    for limit in ("MOST_NAMES", "MOST_INNER"):
        with monkeypatch.context() as m:
            m.setattr(walks, limit, 3)
            assert rows(walks.traverse_all(nodes.where("id is not null"), edges, 2, True)) == want
