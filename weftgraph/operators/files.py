"""Relations between files, and text of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expr import fold, is_semantic, path_key


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (from_file, to_file) over semantic edges between different files. Each end is looked up once."""
    paths = nodes.where("file_path <> ''").select("id", "file_path")
    ends = edges.where(is_semantic()).select("source_id", "target_id").distinct()
    out = ends.join(paths.toDF("source_id", "from_file"), "source_id").join(paths.toDF("target_id", "to_file"), "target_id")
    return out.where(path_key("from_file") != path_key("to_file")).select("from_file", "to_file").distinct()


def file_dependencies(nodes: DataFrame, edges: DataFrame, incoming: bool = False) -> DataFrame:
    """(file, other): files that a file depends on, or (incoming) that depend on it; paths that differ by case are one,
    shown by the smallest."""
    return told_links(file_links(nodes, edges), incoming)


def told_links(links: DataFrame, incoming: bool = False) -> DataFrame:
    """(file, other) of distinct (from_file, to_file), as file_dependencies tells them."""
    a, b = ("to_file", "from_file") if incoming else ("from_file", "to_file")
    return links.groupBy(F.col(a).alias("file"), fold(b).alias("key")).agg(F.min(b).alias("other")).select("file", "other")


def related_items(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, proximity): 0 for nodes of the same file, 1 for those of the same namespace."""
    r = roots.select(F.col("id").alias("root"), path_key("file_path").alias("rp"), fold("namespace").alias("rn"))
    n = nodes.select(F.col("id").alias("node"), path_key("file_path").alias("np"), fold("namespace").alias("nn"))
    same = r.where("rp <> ''").join(n, F.col("rp") == F.col("np")).select("root", "node", F.lit(0).alias("proximity"))
    close = r.where("rn <> ''").join(n, F.col("rn") == F.col("nn")).select("root", "node", F.lit(1).alias("proximity"))
    return same.union(close).where("root <> node").groupBy("root", "node").agg(F.min("proximity").alias("proximity"))


def related_groups(nodes: DataFrame) -> DataFrame:
    """(proximity, group, node): every node in the group of its file (0) and of its namespace (1), which is all of
    related_items in as many rows as there are nodes: a root's items are the other members of its groups, by the least
    proximity."""
    files = nodes.select(F.lit(0).alias("proximity"), path_key("file_path").alias("group"), F.col("id").alias("node"))
    spaces = nodes.select(F.lit(1).alias("proximity"), fold("namespace").alias("group"), F.col("id").alias("node"))
    return files.union(spaces).where("group <> ''")


def related_order(nodes: DataFrame) -> DataFrame:
    """(proximity, group, node, place): the groups of related_groups with each node's place in the order in which related
    items are told; a root's own list is its groups' without itself, nearer groups first."""
    own = nodes.select(F.col("id").alias("node"), fold("type").alias("k"), fold("file_path").alias("p"), "start_line", "start_col", fold("name").alias("n"))
    order = Window.partitionBy("proximity", "group").orderBy("k", "p", "start_line", "start_col", "n", "node")
    return related_groups(nodes).join(own, "node").withColumn("place", F.row_number().over(order)).select("proximity", "group", "node", "place")


def content_snippet(nodes: DataFrame, files: DataFrame, fix_offset: bool = False) -> DataFrame:
    """(id, content): the lines of a span out of files (file_path, text). Stored spans count from 0 but are cut as if
    from 1, which shifts the text up by a line; fix_offset cuts them as stored."""
    lines = F.split("text", "\n", -1)
    back = 0 if fix_offset else 1
    first = F.greatest(F.lit(0), F.col("start_line") - back)
    last = F.least(F.size(lines) - 1, F.col("end_line") - back)
    return nodes.join(files, "file_path").select("id", F.when(last >= first, F.array_join(F.slice(lines, first + 1, F.greatest(last - first + 1, F.lit(0))), "\n")).otherwise("").alias("content"))
