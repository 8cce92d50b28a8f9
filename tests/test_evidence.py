"""Evidence by query: of all files that names speak for, and of all members of a type."""

import pytest

from weftgraph.plans import queries
from weftgraph.plans.adapter import Graph

NODE = "id string, name string, type string, file_path string, start_line int, signature string, is_test string"
EDGE = "id string, source_id string, target_id string, type string, line bigint"


@pytest.fixture(scope="module")
def wide(spark):
    """Two test files of twelve methods each that name the root; a method calls the last of a type's 201 members."""
    tests = [(f"{f}{i:02d}", f"TestGear{i}", "Method", f"/tests/{f}.cs") for f in "AB" for i in range(12)]
    members = [(f"m{i:03d}", f"Part{i}", "Method", "/src/W.cs") for i in range(201)]
    rows = [("gear", "Gear", "Class", "/src/G.cs"), ("cls", "Wheel", "Class", "/src/W.cs"), ("t", "TestIt", "Method", "/tests/Z.cs"), *tests, *members]
    n = spark.createDataFrame([(i, name, kind, path, k, name, None) for k, (i, name, kind, path) in enumerate(rows)], NODE)
    e = [(f"h{i:03d}", "cls", f"m{i:03d}", "HAS_METHOD", None) for i in range(201)]
    return Graph(n, spark.createDataFrame([*e, ("x", "t", "m200", "CALLS", None)], EDGE))


def test_heuristics_of_all_files(wide):
    got = queries.heuristic_tests(wide).where("root = 'gear'").collect()
    assert {(r.file, r.method) for r in got} == {(f"/tests/{f}.cs", f"{f}{i:02d}") for f in "AB" for i in range(12)}


def test_files_of_all_names_and_members(wide):
    got = {(r.root, r.file, r.evidence): r.methods for r in queries.test_evidence_files(wide).collect()}
    assert {f for r, f, tag in got if (r, tag) == ("gear", "namingHeuristic")} == {"/tests/A.cs", "/tests/B.cs"}
    assert got["gear", "/tests/B.cs", "heuristicMethod"] == 12 and got["cls", "/tests/Z.cs", "memberCall"] == 1


def test_summary_of_all_names_and_members(wide):
    got = {r.root: r for r in queries.test_evidence_summary(wide).where("root in ('gear', 'cls')").collect()}
    assert got["gear"].heuristics == 24 and got["gear"].files == 2
    assert got["cls"].directly_tested and got["cls"].is_tested
