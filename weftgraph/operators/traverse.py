"""Traversal with a deterministic winner, many roots in one plan.

A node's winning path is the smallest by (seed order, edges in order), which is the order in which a breadth-first
search over sorted edges would reach it; so each level is a join, a min and an anti-join, and no level depends on
row order or partitioning. Edges are numbered once in their order, so a path is an array of numbers. Where nobody asks
for paths, a level is a distinct and an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expr import fold, is_family, is_usage, shown
from weftgraph.operators.components import components
from weftgraph.plans.staging import checkpointed


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def _steps(edges: DataFrame, *ways: bool) -> DataFrame:
    """(at, to, step, shown): edges to follow, forwards (False) or backwards (True), numbered by id, ends and type."""
    kind = F.coalesce("type", F.lit(""))
    ordered = edges.select(F.coalesce("id", F.lit("")).alias("eid"), "source_id", "target_id", kind.alias("kind"), shown().alias("shown")).orderBy("eid", "source_id", "target_id", "kind")
    numbered = checkpointed(ordered.select("source_id", "target_id", "shown", F.monotonically_increasing_id().alias("step")))  # in the order of the sort
    out = None
    for backwards in ways:
        at, to = ("target_id", "source_id") if backwards else ("source_id", "target_id")
        part = numbered.select(F.col(at).alias("at"), F.col(to).alias("to"), "step", "shown")
        out = part if out is None else out.union(part)
    return out


def _levels(seeds: DataFrame, steps: DataFrame, depth: int | None) -> DataFrame:
    """(root, node, distance, seed_ord, key, path) of seeds (root, node, seed_ord) and all that they reach."""
    none = [F.expr("cast(array() as array<bigint>)").alias("key"), F.expr("cast(array() as array<string>)").alias("path")]
    visited = checkpointed(seeds.select("root", "node", F.lit(0).alias("distance"), "seed_ord", *none))
    frontier, level = visited, 0
    while depth is None or level < depth:
        level += 1
        way = F.struct("seed_ord", F.concat("key", F.array("step")).alias("key"), F.concat("path", F.array("shown")).alias("path"))
        cand = frontier.join(steps, frontier["node"] == steps["at"]).select("root", F.col("to").alias("node"), way.alias("way"))
        cand = cand.groupBy("root", "node").agg(F.min("way").alias("way"))
        fresh = cand.join(visited.select("root", "node"), ["root", "node"], "left_anti")
        frontier = checkpointed(fresh.select("root", "node", F.lit(level).alias("distance"), "way.*"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def reach(seeds: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance) of seeds (root, node) and all that they reach over pairs (at, to), without paths."""
    visited = checkpointed(seeds.select("root", "node", F.lit(0).alias("distance")).distinct())
    frontier = visited
    for level in range(1, depth + 1):
        cand = frontier.join(pairs, frontier["node"] == pairs["at"]).select("root", F.col("to").alias("node")).distinct()
        frontier = checkpointed(cand.join(visited.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("distance")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def traverse(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, incoming: bool) -> DataFrame:
    """(root, node, distance, relation_path) of what each root uses, or (incoming) is used by."""
    usage = resolved(edges.where(is_usage()), nodes)
    seeds = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("seed_ord")).distinct()
    return _paths(_levels(seeds, _steps(usage, incoming), depth))


def _paths(levels: DataFrame) -> DataFrame:
    return levels.where("distance > 0").select("root", "node", "distance", F.col("path").alias("relation_path"))


def families(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, head): the family of every node that implements or overrides another, or is so; once for all roots."""
    kin = resolved(edges.where(is_family()), nodes)
    return components(kin.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


def heads_of(roots: DataFrame, family: DataFrame) -> DataFrame:
    """(root, head): a root without a family is its own."""
    return roots.select(F.col("id").alias("root")).distinct().join(family, F.col("root") == F.col("node"), "left").select("root", F.coalesce("head", "root").alias("head"))


def members_of(heads: DataFrame, family: DataFrame) -> DataFrame:
    """(head, node) of the families that (root, head) name, single ones included."""
    asked = heads.select("head").distinct()
    return asked.join(family, "head", "left").select("head", F.coalesce("node", "head").alias("node"))


def method_family(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): all methods joined by implementing or overriding, the root among them."""
    family = families(nodes, edges)
    heads = heads_of(roots, family)
    return heads.join(members_of(heads, family), "head").select("root", "node")


def family_order(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, distance, ord): the family in the order of discovery from each root, which decides between paths."""
    kin = resolved(edges.where(is_family()), nodes)
    seeds = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("seed_ord")).distinct()
    found = _levels(seeds, _steps(kin, False, True), None)
    return found.select("root", "node", "distance", F.row_number().over(Window.partitionBy("root").orderBy("distance", "key")).alias("ord"))


def family_used_by(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance, relation_path) of callers of any member of the root's family, members left out."""
    usage = resolved(edges.where(is_usage()), nodes)
    seeds = checkpointed(family_order(nodes, edges, roots)).select("root", "node", F.col("ord").alias("seed_ord"))
    return _paths(_levels(seeds, _steps(usage, True), depth))


def family_reach(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance): the same without paths, walked once for each family."""
    usage = resolved(edges.where(is_usage()), nodes).select(F.col("target_id").alias("at"), F.col("source_id").alias("to")).distinct()
    family = families(nodes, edges)
    heads = checkpointed(heads_of(roots, family))
    found = reach(members_of(heads, family).select(F.col("head").alias("root"), "node"), checkpointed(usage), depth)
    return heads.join(found.where("distance > 0").withColumnRenamed("root", "head"), "head").select("root", "node", "distance")


def in_order(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same with each row's place for its root: by distance, then identifier."""
    told = found.join(nodes.select(F.col("id").alias("node"), "identifier"), "node")
    return told.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("distance", "identifier", "node")))


def statically_bound_targets(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of family members with a caller."""
    called = resolved(edges.where(is_usage()), nodes).select(F.col("target_id").alias("node"))
    return method_family(nodes, edges, roots).join(called, "node", "left_semi").select("root", "node")


def bindings(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, caller, bindings): how a caller reaches the root's family. A member is the interface's or the base's where
    another member implements or overrides it (by the first such edge), the root itself is exact, others implementations."""
    family = checkpointed(method_family(nodes, edges, roots))
    kin = edges.where(is_family()).groupBy("target_id").agg(fold(F.min(F.struct("id", "type"))["type"]).alias("kind"))
    label = F.when(F.col("kind") == "IMPLEMENTS_MEMBER", "interface").when(F.col("kind") == "OVERRIDES_MEMBER", "base").when(F.col("node") == F.col("root"), "exact").otherwise("implementation")
    named = family.join(kin, F.col("node") == F.col("target_id"), "left").select("root", "node", label.alias("label"))
    usage = resolved(edges.where(is_usage()), nodes).select("source_id", F.col("target_id").alias("node"))
    callers = named.join(usage, "node").join(family.select("root", F.col("node").alias("source_id")), ["root", "source_id"], "left_anti")
    return callers.groupBy("root", F.col("source_id").alias("caller")).agg(F.array_sort(F.collect_set("label")).alias("bindings"))


def occurrences(usage: DataFrame, near: str, far: str, lines: int) -> DataFrame:
    """Per (near end, far end): edges, relations by rank, call sites and the first lines (from 1)."""
    from weftgraph.functions.expr import relation_rank

    line = F.expr("try_cast(line as bigint)") + 1
    out = usage.groupBy(F.col(near).alias("root"), F.col(far).alias("node")).agg(
        F.count("*").alias("edge_count"),
        F.array_sort(F.collect_set(F.struct(relation_rank().alias("rank"), shown().alias("kind")))).alias("kinds"),
        F.array_sort(F.collect_set(line)).alias("all_lines"),
        F.min(relation_rank()).alias("min_rank"),
    )
    return out.select("root", "node", "edge_count", F.transform("kinds", lambda x: x["kind"]).alias("relations"), F.size("all_lines").alias("call_sites"), F.slice("all_lines", 1, lines).alias("lines"), "min_rank")
