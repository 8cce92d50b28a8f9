"""Counts over graphs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expr import complexity, is_usage, language_of
from weftgraph.operators.lifecycle import ScanState
from weftgraph.plans.adapter import Graph

STATUSES = ("Pending", "Processing", "Completed", "Failed", "Skipped")


def graph_stats(graph: Graph) -> DataFrame:
    """(what, kind, n): totals, and counts by type of nodes and edges that have one."""
    out = None
    for what, df in (("node", graph.nodes), ("edge", graph.edges)):
        n = df.groupBy("type").agg(F.count("*").alias("n"))
        kinds = n.where("type <> ''").select(F.lit(what).alias("what"), F.col("type").alias("kind"), "n")
        total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(what).alias("what"), F.lit("*").alias("kind"), "n")
        part = kinds.union(total)
        out = part if out is None else out.union(part)
    return out


def status(graph: Graph, state: ScanState) -> DataFrame:
    """One row: totals, counts by kind as maps, and the scan's state."""
    rows = graph_stats(graph)
    kinds = lambda what: F.map_from_entries(F.collect_list(F.when((F.col("what") == what) & (F.col("kind") != "*"), F.struct("kind", "n"))))
    total = lambda what: F.max(F.when((F.col("what") == what) & (F.col("kind") == "*"), F.col("n")))
    out = rows.agg(total("node").alias("nodes"), total("edge").alias("edges"), kinds("node").alias("node_kinds"), kinds("edge").alias("edge_kinds"))
    return out.select("*", F.lit(graph.version).alias("version"), F.lit(state.state).alias("state"), F.lit(state.operation).cast("bigint").alias("operation"), F.lit(state.error).cast("string").alias("error"))


def file_stats(metadata: DataFrame) -> DataFrame:
    """(what, value, n): files by status, all statuses present, and by language."""
    spark = metadata.sparkSession
    status = spark.createDataFrame([(s,) for s in STATUSES], "value string").join(metadata.groupBy(F.col("status").alias("value")).agg(F.count("*").alias("n")), "value", "left")
    language = metadata.groupBy(language_of().alias("value")).agg(F.count("*").alias("n"))
    return status.select(F.lit("status").alias("what"), "value", F.coalesce("n", F.lit(0)).alias("n")).union(language.select(F.lit("language"), "value", "n"))


def metrics(graph: Graph, roots: DataFrame) -> DataFrame:
    """(id, complexity, lines, uses, used_by) of roots, which are nodes of the graph: direct neighbours count once each.

    Both ends of an edge are counted in one aggregation and meet the nodes in one semi-join, on the far end.
    """
    end = lambda own, far, uses: F.struct(F.col(own).alias("id"), F.col(far).alias("far"), F.lit(uses).alias("uses"))
    usage = graph.edges.where(is_usage()).where("source_id <> target_id").select("source_id", "target_id").distinct()
    ends = usage.select(F.inline(F.array(end("source_id", "target_id", True), end("target_id", "source_id", False))))
    ends = ends.join(graph.nodes.select(F.col("id").alias("far")), "far", "left_semi")
    counts = ends.groupBy("id").agg(F.count_if("uses").alias("uses"), F.count_if(~F.col("uses")).alias("used_by"))
    out = roots.join(counts, "id", "left")
    return out.select("id", complexity().alias("complexity"), (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used_by", F.lit(0)).alias("used_by"))
