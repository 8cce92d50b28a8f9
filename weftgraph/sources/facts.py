"""Facts from outside: extractors by extension, chunks of facts as JSON lines, and whole graphs as one document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.expr import col
from weftgraph.plans.adapter import Graph
from weftgraph.plans.staging import STAGING, checkpointed, held

CHUNK = 2000
#: Rows of a staged file of facts: few enough bytes for a task to read it whole (spark.sql.files.maxPartitionBytes).
FILE_ROWS = 250_000
NODE = "struct<id:string,identifier:string,name:string,type:string,file_path:string,start_line:int,end_line:int,start_col:int,namespace:string,signature:string,is_test:string>"
EDGE = "struct<id:string,source_id:string,target_id:string,type:string,line:bigint,col:bigint>"
DELTA = f"parser_id string, workspace_id string, generation bigint, request_id bigint, chunk_ord int, replaces_workspace boolean, replaces_files array<string>, nodes array<{NODE}>, edges array<{EDGE}>, is_last_for_request boolean"
FACT = "kind string, id string, identifier string, name string, type string, file_path string, start_line int, end_line int, source_id string, target_id string"


@dataclass(frozen=True)
class FactExtractor:
    """What reads one language: frames of (path, text) in, frames of FACT rows out."""

    parser: str
    extensions: tuple[str, ...]
    extract: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass
class Registry:
    """Extractors in the order of their claims; the first to claim an extension has it."""

    extractors: list[FactExtractor] = field(default_factory=list)

    def claims(self, spark: SparkSession) -> DataFrame:
        rows = [(e.lower().lstrip("."), x.parser, i) for i, x in enumerate(self.extractors) for e in x.extensions]
        return spark.createDataFrame(rows, "extension string, parser_id string, claim int")

    def full_scan(self, files: DataFrame) -> tuple[DataFrame | None, list[Exception]]:
        """Facts of all files (path, text), and the failures: one extractor that fails doesn't stop the others. Each runs
        to its end here, into the shared folder, so a failure shows before anything is committed."""
        owned = owner_of(files, self.claims(files.sparkSession))
        out, failures = None, []
        for x in self.extractors:
            own = owned.where(F.col("parser_id") == x.parser).select("path", "text")
            try:
                facts = checkpointed(own.mapInPandas(x.extract, FACT).withColumn("parser_id", F.lit(x.parser)))
            except Exception as e:  # noqa: BLE001
                failures.append(e)
                continue
            out = facts if out is None else out.union(facts)
        return out, failures


def extension_of(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./\\]*)$", 1))


def owner_of(paths: DataFrame, claims: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a table with the parser_id that owns their path's extension, null without one. Claims (extension,
    parser_id, claim) are one row an extension once the first has been taken."""
    first = claims.groupBy("extension").agg(F.min_by("parser_id", "claim").alias("parser_id"))
    return paths.join(first, extension_of(path) == F.col("extension"), "left").drop("extension")


def stamp_ownership(metadata: Column | str, parser: Column | str, workspace: Column | str) -> Column:
    """The map with the owner's keys, which win over the source's own."""
    kept = F.map_filter(col(metadata), lambda k, _: ~k.isin("parser_id", "workspace_id"))
    return F.map_concat(kept, F.create_map(F.lit("parser_id"), col(parser), F.lit("workspace_id"), col(workspace)))


def workspace_uri(text: Column | str) -> Column:
    """Escaped for a URI, spaces as %20."""
    return F.replace(F.url_encode(col(text)), F.lit("+"), F.lit("%20"))


def within(columns: Sequence[str], text: str = "id") -> list[Column]:
    """The columns (three at most) and a number ``spots``: where one is a part of the text, it is null and its place and
    length stand in the number. An edge's id holds its ends and type, so this halves the bytes of edges in a shuffle."""
    at = {c: F.expr(f"coalesce(locate(`{c}`, `{text}`), 0)") for c in columns}
    held = {c: at[c].between(1, 1023) & (F.char_length(c) <= 1023) for c in columns}
    spots = [F.when(held[c], F.shiftleft(at[c].cast("long"), 20 * i) + F.shiftleft(F.char_length(c).cast("long"), 20 * i + 10)).otherwise(F.lit(0).cast("long")) for i, c in enumerate(columns)]
    return [*[F.when(~F.coalesce(held[c], F.lit(False)), F.col(c)).alias(c) for c in columns], reduce(lambda x, y: x + y, spots).alias("spots")]


def unfolded(columns: Sequence[str], text: str = "id") -> list[Column]:
    """The columns as they were before ``within``."""
    bits = lambda i: F.shiftright("spots", i).bitwiseAND(1023).cast("int")
    return [F.when(bits(20 * i) > 0, F.col(text).substr(bits(20 * i), bits(20 * i + 10))).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)]


def chunked(df: DataFrame, size: int = CHUNK, fold: Sequence[str] = (), rows: int = FILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(facts in the order of ids, null last, with their block, chunk and place; a row per block with its shard and first
    place, its rows and the shard's). A block is a file of at most ``rows`` of one shard, read by one task in its order.
    Facts go once through a shuffle, into ranges of ids, where equal ones meet and are told once; columns of ``fold`` go
    as parts of the id."""
    shard, own = ["parser_id", "workspace_id"], df.columns
    order = [*shard, F.col("id").asc_nulls_last()]
    slim = df.select(*[c for c in own if c not in fold], *within(fold)) if fold else df
    lying = slim.repartitionByRange(*order).distinct().sortWithinPartitions(*order)
    lying = checkpointed(lying.withColumn("at", F.monotonically_increasing_id()), maxRecordsPerFile=rows)
    lying = lying.withColumn("file", F.shiftright("at", 33) * (1 << 31) + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / rows))
    found = lying.groupBy(*shard, "file").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row per shard and file
    all_of, up_to = Window.partitionBy(*shard), Window.partitionBy(*shard).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(up_to), F.lit(0))
    blocks = checkpointed(found.select(*shard, "file", "first", "n", before.alias("before"), F.sum("n").over(all_of).alias("total"), F.row_number().over(Window.orderBy(*shard, "file")).alias("block")))
    facts = lying.join(F.broadcast(blocks), [*shard, "file"])
    place = F.col("before") + F.col("at") - F.col("first")
    facts = facts.select(*[c for c in own if c not in fold], *(unfolded(fold) if fold else []), "block", F.floor(place / size).cast("int").alias("chunk"), (place % size).cast("int").alias("place"))
    return facts.select(*own, "block", "chunk", "place"), blocks


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, chunk, fact) in order: a row for each (block, chunk) with its facts as a list."""

    def row(block: int, chunk: int, parts: list[pa.Array]) -> pa.RecordBatch:
        facts = pa.concat_arrays(parts)
        listed = pa.ListArray.from_arrays(pa.array([0, len(facts)], pa.int32()), facts)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([chunk], pa.int32()), listed], ["block", "chunk", "facts"])

    key, parts = None, []
    for batch in batches:
        block, chunk, facts = (batch.column(batch.schema.get_field_index(c)) for c in ("block", "chunk", "fact"))
        if not len(facts):
            continue
        both = np.stack([block.to_numpy(), chunk.to_numpy()])
        cuts = [0, *(np.flatnonzero((both[:, 1:] != both[:, :-1]).any(0)) + 1).tolist(), len(facts)]
        for a, b in zip(cuts, cuts[1:]):
            now = (int(both[0, a]), int(both[1, a]))
            if key is not None and now != key:
                yield row(*key, parts)
                parts = []
            key = now
            parts.append(facts.slice(a, b - a))
    if key is not None:
        yield row(*key, parts)


def gathered(facts: DataFrame, blocks: DataFrame, size: int, fact: Column, shape: str) -> DataFrame:
    """(parser_id, workspace_id, chunk, facts): chunks within a block are cut from its rows as they are read; only those
    that lie across blocks are shuffled. A file that was read in two parts would give a chunk of too few facts: an error."""
    shard = ["parser_id", "workspace_id"]
    end = F.col("before") + F.col("n")
    last = F.when((end % size != 0) & (end < F.col("total")), F.floor(end / size).cast("int"))
    edge = blocks.select("block", F.when(F.col("before") % size != 0, F.floor(F.col("before") / size).cast("int")).alias("head"), last.alias("tail"))
    rows = facts.join(F.broadcast(edge), "block")
    across = F.coalesce(F.col("chunk") == F.col("head"), F.lit(False)) | F.coalesce(F.col("chunk") == F.col("tail"), F.lit(False))
    cut = rows.where(~across).select("block", "chunk", fact.cast(shape).alias("fact")).mapInArrow(_runs, f"block int, chunk int, facts array<{shape}>")
    cut = cut.join(F.broadcast(blocks.select(*shard, "block", "total")), "block")
    whole = F.size("facts") == F.least(F.lit(size), F.col("total") - F.col("chunk").cast("long") * size)
    cut = cut.select(*shard, "chunk", F.when(whole, F.col("facts")).otherwise(F.raise_error(F.lit("a staged file was read in parts"))).alias("facts"))
    met = rows.where(across).groupBy(*shard, "chunk").agg(F.array_sort(F.collect_list(F.struct("place", fact.cast(shape).alias("fact"))))["fact"].alias("facts"))
    return cut.union(met)


def delta_chunks(graph: Graph, generation: int, request: int, size: int = CHUNK, rows: int = FILE_ROWS) -> DataFrame:
    """Rows of DELTA: a shard's nodes, then its edges, at most ``size`` a chunk, at least one chunk, the last one marked.
    How many chunks a shard has is known from its blocks, so facts are gathered once. Equal facts are told once."""
    shard, shapes, ends = ["parser_id", "workspace_id"], {"node": NODE, "edge": EDGE}, ("source_id", "target_id", "type")
    names = {kind: [x.split(":")[0] for x in shape[7:-1].split(",")] for kind, shape in shapes.items()}
    placed = {kind: chunked(df.select(*shard, *names[kind]), size, ends if kind == "edge" else (), rows) for kind, df in (("node", graph.nodes), ("edge", graph.edges))}
    counts = [b.groupBy(*shard).agg(F.max("total").alias("n")).select(*shard, F.lit(kind).alias("kind"), F.ceil(F.col("n") / size).cast("int").alias("n")) for kind, (_, b) in placed.items()]
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    chunks = F.broadcast(checkpointed(counts[0].union(counts[1]).groupBy(*shard).agg(of("node").alias("nodes_end"), of("edge").alias("edges_end"))))
    out = None
    for kind, shape in shapes.items():
        found = gathered(*placed[kind], size, F.struct(*[F.col(c) for c in names[kind]]), shape).join(chunks, shard)
        at = F.col("chunk") if kind == "node" else F.col("chunk") + F.col("nodes_end")
        none = {"node": F.expr(f"cast(array() as array<{EDGE}>)"), "edge": F.expr(f"cast(array() as array<{NODE}>)")}[kind]
        pair = [F.col("facts").alias("nodes"), none.alias("edges")] if kind == "node" else [none.alias("nodes"), F.col("facts").alias("edges")]
        part = found.select(*shard, F.lit(generation).cast("bigint").alias("generation"), F.lit(request).cast("bigint").alias("request_id"), at.alias("chunk_ord"), F.lit(True).alias("replaces_workspace"), F.expr("cast(array() as array<string>)").alias("replaces_files"), *pair, (at + 1 == F.col("nodes_end") + F.col("edges_end")).alias("is_last_for_request"))
        out = part if out is None else out.union(part)
    return out


def write_deltas(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, packed, since facts of one file repeat each other."""
    with held(chunks.sparkSession, **STAGING):
        chunks.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines."""
    return spark.read.schema(DELTA).json(path)


def follow_deltas(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The same as a stream; ``files_at_once`` holds a trigger's intake down."""
    return spark.readStream.schema(DELTA).option("maxFilesPerTrigger", files_at_once).json(path)


def json_reconcile(documents: DataFrame, before: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphs as documents (json) with nodes and edges replace all there is: (nodes, edges, counts of what was done)."""
    parsed = documents.select(F.from_json("json", f"nodes array<{NODE}>, edges array<{EDGE}>").alias("x"))
    nodes = parsed.select(F.inline("x.nodes")).dropDuplicates(["id"])
    edges = parsed.select(F.inline("x.edges")).dropDuplicates(["id"])
    names = ("nodes_merged", "edges_merged", "nodes_deleted")
    rows = [df.agg(F.count("*").alias("n")).select(*[(F.col("n") if i == k else F.lit(None).cast("bigint")).alias(x) for k, x in enumerate(names)]) for i, df in enumerate((nodes, edges, before.nodes))]
    counts = rows[0].union(rows[1]).union(rows[2]).agg(*[F.max(x).alias(x) for x in names])
    return nodes, edges, counts.withColumn("operation", F.lit("reconcile"))


def nearest_ancestor(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest of the roots (root) that is the path or a folder above it. Paths offer each of their
    folders, and equal ones meet."""
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = paths.select("path", F.explode(above).alias("at")).join(roots.select("root", F.regexp_replace("root", "/+$", "").alias("at")), "at")
    return met.groupBy("path").agg(F.max_by("root", F.char_length("at")).alias("root"))


def same_file(a: Column | str, b: Column | str) -> Column:
    """Do two paths name one file: equal, or one the end of the other after a slash, whatever the case."""
    from weftgraph.functions.expr import path_key

    x, y = path_key(a), path_key(b)
    return (x == y) | x.endswith(F.concat(F.lit("/"), y)) | y.endswith(F.concat(F.lit("/"), x))


def files_to_scan(files: DataFrame, metadata: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file_path, parser_id) to read, file_path of metadata to prune): a parser with any new or changed file reads all it owns."""
    from weftgraph.operators.commit import needs_processing

    owned = owner_of(files, claims, "file_path").where("parser_id is not null")
    changed = needs_processing(files, metadata).join(owned.select("file_path", "parser_id"), "file_path").select("parser_id").distinct()
    gone = metadata.join(files.select("file_path"), "file_path", "left_anti").select("file_path")
    return owned.join(changed, "parser_id", "left_semi").select("file_path", "parser_id"), gone


def rolled_back(metadata: DataFrame) -> DataFrame:
    """Metadata after a scan that failed: what failed stays so, all else is to be read again."""
    return metadata.withColumn("status", F.when(F.col("status") == "Failed", "Failed").otherwise("Pending"))


def first_claims(extractors: Sequence[FactExtractor]) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in extractors:
        for e in x.extensions:
            out.setdefault(e.lower().lstrip("."), x.parser)
    return out
