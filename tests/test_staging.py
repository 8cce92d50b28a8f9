"""What staging tells Spark of sizes."""

from pyspark.sql import functions as F

from weftgraph.operators import evidence
from weftgraph.plans.staging import checkpointed


def joined(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_of_many_rows_are_no_broadcast(spark, monkeypatch):
    """Two staged tables of 200,000 ids, of under 10 MB as Parquet: a plan as it is staged sorts them, and sizes that Spark
    takes from files are as before afterwards."""
    key = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(key)
    ids = checkpointed(spark.range(200_000).select(F.concat(F.lit("ship:default:part/"), "id").alias("id"), F.col("id").alias("n")))
    pairs = ids.join(ids.select("id", F.col("n").alias("m")), "id")
    plans = []
    write = type(pairs.write).parquet
    monkeypatch.setattr(type(pairs.write), "parquet", lambda self, path: (plans.append(joined(pairs.select("*"))), write(self, path))[1])
    assert checkpointed(pairs).count() == 200_000
    assert "BroadcastHashJoin" not in plans[0] and "SortMergeJoin" in plans[0]
    assert spark.conf.get(key) == before
    assert "BroadcastHashJoin" in joined(pairs.select("*"))


def test_what_evidence_leaves_open_is_no_broadcast(spark):
    """Rows of evidence are staged; the summary and the capped files of all roots join them by sorting."""
    nodes = spark.createDataFrame([("t", "test_a", "Method", "/wh/tests/T.cs", 1, "s", "test_a()", "true"), ("a", "a", "Method", "/wh/a.cs", 1, "s", "a()", "false")], "id string, name string, type string, file_path string, start_line int, namespace string, signature string, is_test string")
    edges = spark.createDataFrame([("e", "t", "a", "CALLS", 1)], "id string, source_id string, target_id string, type string, line bigint")
    found = evidence.evidence(nodes, edges, nodes)
    assert "Join" not in joined(found)
    assert {(r.root, r.evidence) for r in found.collect()} >= {("a", "directCall"), ("a", "testReference")}
    for out in (evidence.summary(found, nodes), evidence.test_files(found, nodes)):
        assert "BroadcastHashJoin" not in joined(out)
        assert out.count() >= 1


def test_parts_of_texts_are_no_broadcast(spark, monkeypatch):
    """Many names: the exploded parts are sorted, not sent to the driver; few: the names are sent. The same rows by both."""
    from weftgraph.operators import resolve

    texts = spark.createDataFrame([(f"test_order_{i}",) for i in range(300)], "text string")
    names = spark.createDataFrame([(f"order_{i}",) for i in range(300)] + [("",)], "name string")
    want = {(f"test_order_{i}", f"order_{j}") for i in range(300) for j in range(300) if str(i).startswith(str(j))}
    few = resolve.parts_found(texts, names)
    monkeypatch.setattr(resolve, "FEW_NAMES", 100)
    many = resolve.parts_found(texts, names)
    assert "BroadcastHashJoin" in joined(few) and "SortMergeJoin" in joined(many) and "BroadcastHashJoin" not in joined(many)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == want
