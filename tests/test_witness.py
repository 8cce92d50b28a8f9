"""Evidence told from the tests, against the operators that tell it from roots, over random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import evidence, witness
from weftgraph.plans.adapter import Graph

NODE = "id string, name string, type string, file_path string, start_line int, signature string, is_test string"
EDGE = "id string, source_id string, target_id string, type string"
KINDS = ["CALLS", "MOCK_CALLS", "REFERENCES", "IMPLEMENTS", None, "HAS_METHOD", "IMPLEMENTS_MEMBER", "OVERRIDES_MEMBER"]


@pytest.fixture(scope="module")
def drawn(spark):
    """Families, containers, cycles, edges of tests to themselves and to nothing; names in names, also not ASCII."""
    r = random.Random(5)
    nodes = []
    for i in range(60):
        test, kind = i % 3 == 0, r.choice(["Method", "Method", "Class"])
        name = r.choice(["Gär", "GetCog", "cog", "Ä", "Wheel", "", None, "SetÄCog", "Order_1", "Order_12"]) if not test else r.choice(["Test", "test_", "Helps"]) + r.choice(["Gär", "Cog", "äcog", "Order_12", "turns"])
        path = r.choice(["/tests/Wheels.cs", "/TESTS/wheels.cs", "/spec/ÄTurn.cs", "/tests/C.cs", "/tests/D"]) if test else "/src/A.cs"
        nodes.append((f"n{i:02d}", name, kind, path, r.choice([None, 1, 2]), name and name + "( cog )", None))
    ids = [n[0] for n in nodes] + ["gone"]
    edges = [(f"e{i}", r.choice(ids), r.choice(ids), r.choice(KINDS)) for i in range(150)]
    edges += [(f"t{i}", f"n{3 * r.randrange(20):02d}", r.choice(ids), r.choice(KINDS[:5])) for i in range(40)]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame([*edges, edges[0]], EDGE)
    return Graph(n, e), evidence.evidence(n, e, n), evidence.evidence(n, e, n, heuristic_nodes=3)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_heuristics(drawn):
    want = rows(drawn[1].where("evidence = 'heuristicMethod'").select("root", "file", "method"))
    assert rows(witness.heuristics(drawn[0])) == want and len(want) > 20


def test_counts_by_file(drawn):
    want = drawn[1].groupBy("root", "file", "evidence").agg(F.count_distinct("method").alias("methods"))
    assert rows(witness.by_file(drawn[0])) == rows(want)
    assert {r.evidence for r in want.collect()} == set(witness.TAGS)


def test_summary(drawn):
    want = evidence.summary(drawn[1], drawn[0].nodes)
    assert rows(witness.summary(drawn[0]).select(want.columns)) == rows(want)


def test_capped(drawn):
    """Files and methods are capped alike, and names where a cap is asked for."""
    n = drawn[0].nodes
    want = evidence.test_files(drawn[2], n)
    assert rows(witness.capped(drawn[0], 3).select(want.columns)) == rows(want)
