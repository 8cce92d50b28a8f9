"""Snapshot algebra: what a commit of facts does to nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.adapter import Graph


def dedup_last_wins(df: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The row of each key that is last in an explicit order."""
    return df.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_order"), F.struct(*df.columns).alias("_row"))).alias("_last")).select("_last._row.*")


def ordinal_min_owner(facts: DataFrame) -> DataFrame:
    """Of facts (id, file_path, pos, ...) the one of the smallest file; within a file the last."""
    way = F.struct(F.col("file_path"), (-F.col("pos")).alias("at"), F.struct(*facts.columns).alias("fact"))
    return facts.groupBy("id").agg(F.min(way).alias("won")).select("won.fact.*")


def check_identifiers(nodes: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one id; a commit with any fails."""
    return nodes.groupBy("identifier").agg(F.count_distinct("id").alias("ids")).where("ids > 1")


def last_of_each(df: DataFrame) -> DataFrame:
    """One row an id: the last by ``ord`` where the delta has that column, else the greatest row."""
    if "ord" in df.columns:
        return dedup_last_wins(df, "ord").drop("ord")
    return df.groupBy("id").agg(F.max(F.struct(*df.columns)).alias("row")).select("row.*")


def checked(graph: Graph) -> Graph:
    """The graph, once no identifier in it stands for several ids."""
    bad = check_identifiers(graph.nodes.where("identifier <> ''")).limit(3).collect()
    if bad:
        raise ValueError(f"identifiers of several nodes: {', '.join(r['identifier'] for r in bad)}")
    return graph


def upsert(graph: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    """Facts in place of those with their ids, in whatever shard these are."""
    new_nodes = graph.nodes if nodes is None else over(graph.nodes, last_of_each(nodes).select(graph.nodes.columns))
    new_edges = graph.edges if edges is None else over(graph.edges, last_of_each(edges).select(graph.edges.columns))
    return Graph(new_nodes, new_edges, graph.version + 1)


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes (id); their edges stay, and dangle."""
    return Graph(graph.nodes.join(ids.select("id"), "id", "left_anti"), graph.edges, graph.version + 1)


def delete_edges_of(graph: Graph, ids: DataFrame) -> Graph:
    """Without the edges that touch the nodes (id)."""
    edges = graph.edges
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return Graph(graph.nodes, edges.select(graph.edges.columns), graph.version + 1)


def over(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows overwritten by new ones."""
    return old.join(new.select(key), key, "left_anti").select(new.columns).unionByName(new)


def commit_scoped(graph: Graph, delta: Graph, parser: str, workspace: str, files: Sequence[str] | None = None) -> Graph:
    """Replace one shard, or its listed files only, by a delta, and sweep the other shards of what that leaves dangling.
    Anti-joins only; the delta and the removed ids are the small sides, and Spark broadcasts them by their size."""
    delta = Graph(last_of_each(delta.nodes).select(graph.nodes.columns), last_of_each(delta.edges).select(graph.edges.columns))
    own = (F.col("parser_id") == parser) & (F.col("workspace_id") == workspace)
    nodes, edges = graph.nodes.where(own), graph.edges.where(own)
    others, foreign = graph.nodes.where(~own), graph.edges.where(~own)
    gone = nodes if files is None else nodes.where((F.col("file_path") != "") & F.col("file_path").isin(list(files)))
    removed = gone.select("id")
    now = over(nodes.join(removed, "id", "left_anti"), delta.nodes)
    lost = removed.join(now.select("id"), "id", "left_anti")
    by = lambda ids, c: ids.withColumnRenamed("id", c)
    kept = edges.join(by(removed, "source_id"), "source_id", "left_anti").join(by(lost, "target_id"), "target_id", "left_anti").select(edges.columns)
    now_edges = over(kept, delta.edges)
    evicted = others.join(delta.nodes.select("id"), "id", "left_semi").select("id")
    others = others.join(evicted, "id", "left_anti")
    foreign = foreign.join(delta.edges.select("id"), "id", "left_anti")
    swept = foreign.join(by(removed, "source_id"), "source_id", "left_anti").join(by(lost, "target_id"), "target_id", "left_anti")
    swept = swept.join(by(evicted, "source_id"), "source_id", "left_anti").join(by(evicted, "target_id"), "target_id", "left_anti")
    return checked(Graph(now.unionByName(others.select(now.columns)), now_edges.unionByName(swept.select(now_edges.columns)), graph.version + 1))


def commit_full(delta: Graph, version: int = 0) -> Graph:
    """A delta in place of everything: one fact an id, no identifier of two nodes."""
    return checked(Graph(last_of_each(delta.nodes), last_of_each(delta.edges), version + 1))


def commit_newer(graph: Graph, delta: Graph, parser: str, workspace: str, generation: int, committed: int, files: Sequence[str] | None = None) -> Graph:
    """commit_scoped, but the graph as it is where the delta's generation isn't beyond the committed one."""
    return commit_scoped(graph, delta, parser, workspace, files) if generation > committed else graph


def incremental_emission(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of changed files, (file_path) that the delta replaces): the changed ones and those that are gone. Keep what
    was ``after`` as the next ``before`` once the delta is out, not earlier."""
    changes = fact_hash_diff(before, after)
    dirty = changes.where("change <> 'removed'").select("file_path")
    return after.join(dirty, "file_path", "left_semi"), changes.select("file_path")


def prune_files(graph: Graph, keep: DataFrame) -> Graph:
    """Drop nodes whose file isn't kept (file_path), and every edge that touches them."""
    gone = graph.nodes.where("file_path <> ''").join(keep.select("file_path"), "file_path", "left_anti").select("id")
    edges = graph.edges
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select(graph.edges.columns), graph.version + 1)


def delta_assemble(chunks: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """Whole deltas out of chunks: for each (parser, workspace) the newest generation beyond the committed one that has
    its last chunk, nodes and edges in chunk order. A newer generation, even unfinished, discards older ones."""
    if committed is not None:
        chunks = chunks.join(committed.select("parser_id", "workspace_id", F.col("generation").alias("done")), ["parser_id", "workspace_id"], "left").where("done is null or generation > done").drop("done")
    newest = chunks.groupBy("parser_id", "workspace_id").agg(F.max("generation").alias("generation"))
    live = chunks.join(newest, ["parser_id", "workspace_id", "generation"])
    # A shard's delta is one row here; assemble_rows gives it as rows, whatever its size.
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", F.col(c)))), lambda x: x[c]))
    whole = live.groupBy("parser_id", "workspace_id", "generation", "request_id").agg(
        F.bool_or("replaces_workspace").alias("replaces_workspace"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("replaces_files")))).alias("replaces_files"), flat("nodes").alias("nodes"), flat("edges").alias("edges"), F.bool_or("is_last_for_request").alias("done")
    )
    return whole.where("done").drop("done")


def assemble_rows(chunks: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """The chunks that belong to whole newest deltas, as rows: same rule as delta_assemble, nothing gathered."""
    shard = ["parser_id", "workspace_id"]
    if committed is not None:
        chunks = chunks.join(committed.select(*shard, F.col("generation").alias("done")), shard, "left").where("done is null or generation > done").drop("done")
    newest = chunks.groupBy(*shard).agg(F.max("generation").alias("generation"))
    live = chunks.join(newest, [*shard, "generation"])
    whole = live.groupBy(*shard, "generation", "request_id").agg(F.bool_or("is_last_for_request").alias("whole")).where("whole").drop("whole")
    return live.join(whole, [*shard, "generation", "request_id"], "left_semi")


def delta_validate(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """(kind, id) of facts that don't belong to the shard that sends them; a commit with any fails."""
    bad = lambda df, c, kind: df.where(~F.coalesce(F.col(c).startswith(prefix), F.lit(False))).select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return bad(nodes, "id", "node").union(bad(edges, "id", "edge")).union(bad(edges, "source_id", "source"))


def fact_hash(nodes: DataFrame) -> DataFrame:
    """(file_path, digest) over a file's facts in the order of their ids."""
    each = F.sha2(F.to_json(F.struct(*sorted(nodes.columns))), 256)
    facts = nodes.select("file_path", "id", each.alias("fact"))
    return facts.groupBy("file_path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "fact"))), lambda x: x["fact"]), ""), 256).alias("digest"))


def fact_hash_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, change): files that are new, differ or are gone."""
    a, b = fact_hash(before).withColumnRenamed("digest", "was"), fact_hash(after).withColumnRenamed("digest", "now")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "file_path", "full_outer").select("file_path", change.alias("change")).where("change is not null")


def needs_processing(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files (file_path, modified) without metadata, not completed, or changed since."""
    out = files.join(metadata.select("file_path", "status", "last_modified"), "file_path", "left")
    return out.where("status is null or status <> 'Completed' or last_modified < modified").select(files.columns)
