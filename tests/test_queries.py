"""Queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.plans import queries as graph

SF = "/root/testdata/sf0.001"
NAMES = [
    "match_cascade", "facets", "rank_related", "topk_with_totals", "file_dependencies", "edge_occurrences", "metrics", "status",
    "find_candidates", "multi_context", "no_match_hint", "compact_relationships", "build_relationships", "lookup_nodes", "nodes_by_paths",
    "traverse_used_by", "bindings", "family_used_by", "test_evidence_files", "member_call_tests",
    "commit_scoped", "upsert_delete", "incremental_emission", "delta_assemble", "delta_source", "stamp_ownership",
    "coalesce_changes", "change_source", "control_events", "resumable_scan", "nearest_ancestor",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = graph.queries()[name](spark, SF)
    r = duck.execute(graph.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select([f"`{c}`" for c in cols]).collect()))) == sorted(map(str, r.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_related_groups_cover_all_roots(spark, duck):
    """Pairs of all roots out of the groups, against related items over all nodes; and the groups against their SQL."""
    from weftgraph.operators import files
    from weftgraph.plans.adapter import star_graph

    got = graph.queries()["related_groups"](spark, SF)
    want = duck.execute(graph.oracle_sql()["related_groups"]).fetchall()
    assert [len({r["group"] for r in got.where(f"proximity = {p}").collect()}) for p in (0, 1)] == [len({r[1] for r in want if r[0] == p}) for p in (0, 1)]
    assert got.count() == len(want)
    nodes = star_graph(spark, SF).nodes.where("id like '%1'")
    rows = files.related_groups(nodes).collect()
    at = {}
    for r in rows:
        at.setdefault((r.proximity, r["group"]), []).append(r.node)
    pairs = {}
    for (p, _), members in at.items():
        for x in members:
            for y in members:
                if x != y:
                    pairs[x, y] = min(p, pairs.get((x, y), p))
    assert {(r.root, r.node): r.proximity for r in files.related_items(nodes, nodes).collect()} == pairs
    assert any("orders" in x for x, _ in pairs)
