"""Requests about symbols, many in one plan: candidates, hints, relationships with caps and totals, and their renderings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expr import compact_signature, display_path, fold, is_test_path, is_usage, relation_rank, shown, type_rank
from weftgraph.operators import files, resolve, traverse
from weftgraph.plans.adapter import Graph
from weftgraph.plans.staging import checkpointed


@dataclass(frozen=True)
class Options:
    """What all requests of a batch share. Bounds are checked before any job runs."""

    depth: int = 1
    max_matches: int = 5
    max_relationships: int = 10
    max_call_sites: int = 3
    max_test_files: int = 5
    max_test_methods: int = 5
    exact: bool | None = None
    expand_ambiguous: bool = False
    include_related: bool = False
    kind: str | None = None
    containing: str | None = None
    namespace: str | None = None
    signature: str | None = None
    file: str | None = None
    relation: str | None = None
    root_path: str = ""
    full: bool = False

    def __post_init__(self) -> None:
        bounds = [("depth", 0, 10), ("max_test_files", 0, 100), ("max_test_methods", 0, 100)]
        if not self.full:
            bounds += [("max_matches", 1, 50), ("max_relationships", 1, 100), ("max_call_sites", 0, 100)]
        for name, low, high in bounds:
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        if self.full and self.relation:
            raise ValueError("relation is for the compact view only")
        resolve.relation_kinds(self.relation)

    def filters(self) -> dict[str, str | None]:
        return {"kind": self.kind, "containing": self.containing, "namespace": self.namespace, "signature": self.signature, "file": self.file}


def check_requests(queries: list[str]) -> list[str]:
    if bad := [i for i, q in enumerate(queries) if not q or not q.strip()]:
        raise ValueError(f"requests {bad} are blank")
    return queries


def ranked(found: DataFrame) -> DataFrame:
    """Candidates with their place among their request's and how many there are."""
    own = Window.partitionBy("req")
    order = resolve.candidate_order(F.col("query"))
    return found.withColumn("place", F.row_number().over(own.orderBy(*order))).withColumn("total", F.count("*").over(own))


def summaries(found: DataFrame, most: int) -> DataFrame:
    """(req, types): a request's most frequent kinds with their counts, as one text."""
    n = found.groupBy("req", fold(F.coalesce("type", F.lit("Unknown"))).alias("key")).agg(F.min(F.coalesce("type", F.lit("Unknown"))).alias("kind"), F.count("*").alias("n"))
    first = n.withColumn("place", F.row_number().over(Window.partitionBy("req").orderBy(F.desc("n"), "key"))).where(F.col("place") <= most)
    rows = F.array_sort(F.collect_list(F.struct("place", F.concat("kind", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text"))))
    return first.groupBy("req").agg(F.array_join(F.transform(rows, lambda x: x["text"]), ", ").alias("types"))


def no_match_hint(requests: DataFrame, found: DataFrame, nodes: DataFrame, options: Options) -> DataFrame:
    """(req, hint) of requests without candidates; with filters, those are asked again without them."""
    rest = requests.join(found.select("req").distinct(), "req", "left_anti").select("req", "query")
    shown_names = {"kind": "type", "containing": "containingType", "namespace": "namespace", "signature": "signature", "file": "sourceFile"}
    applied = [f"{shown_names[k]}={v}" for k, v in options.filters().items() if v is not None]
    none = F.concat(F.lit("No matches found for identifier '"), "query", F.lit("'"))
    if not applied:
        return rest.select("req", none.alias("hint"))
    plain = Options(exact=options.exact)
    probe = resolve.find_candidates(nodes, rest, plain.exact)
    n = probe.groupBy("req").agg(F.count("*").alias("n")).join(summaries(probe, 5), "req")
    some = F.concat(F.lit("No matches for '"), "query", F.lit(f"' with the applied filters ({', '.join(applied)}). "), F.col("n").cast("string"), F.lit(" match(es) exist without filters — types: "), "types", F.lit(". Adjust or drop the filters."))
    never = F.concat(none, F.lit(" — the identifier has no matches even without the applied filters."))
    return rest.join(n, "req", "left").select("req", F.when(F.col("n").isNull(), never).otherwise(some).alias("hint"))


def disambiguation_hint(found: DataFrame) -> DataFrame:
    """(req, hint) of requests with several candidates (ranked)."""
    many = found.where("total > 1")
    first = many.where("place = 1").select("req", "identifier", "total", "match_mode")
    few = F.concat(F.lit("Multiple matches found. Pass identifier='"), "identifier", F.lit("' unchanged, or use containingType, namespace, signature, or sourceFile."))
    narrow = F.concat(F.col("total").cast("string"), F.lit(" matches found. Narrow with type ("), "types", F.lit("), containingType, namespace, signature, or sourceFile."))
    narrow = F.concat(narrow, F.when(F.col("match_mode") == "substring", " Or set exact=true to require an exact name.").otherwise(""))
    path = F.lit("File contains multiple symbols. Specify 'type' or a symbol name to expand one.")
    hint = F.when(F.col("match_mode") == "filePath", path).when(F.col("total") <= 5, few).otherwise(narrow)
    return first.join(summaries(many, 3), "req").select("req", hint.alias("hint"))


def compact_node(root_path: str) -> list[Column]:
    """What a response says of a symbol."""
    where = F.when(F.coalesce("file_path", F.lit("")) != "", display_path("file_path", root_path))
    return [F.col("name"), F.col("type"), where.alias("file"), (F.col("start_line") + 1).alias("line"), compact_signature().alias("signature"), F.col("identifier")]


def answers(requests: DataFrame, found: DataFrame, nodes: DataFrame, options: Options) -> DataFrame:
    """(req, match_mode, substring_skipped, total, ambiguous, returned, truncated, hint): a row per request."""
    hints = no_match_hint(requests, found, nodes, options).union(disambiguation_hint(found) if not options.expand_ambiguous else disambiguation_hint(found).limit(0))
    n = found.groupBy("req").agg(F.first("match_mode").alias("match_mode"), F.max("total").alias("total"))
    out = requests.select("req").join(n, "req", "left").join(hints, "req", "left")
    total = F.coalesce("total", F.lit(0)).cast("long")
    mode = F.coalesce("match_mode", F.lit("substring" if options.exact is not True else "exact"))
    return out.select("req", mode.alias("match_mode"), ((mode == "exact") & F.lit(options.exact is None)).alias("substring_skipped"), total.alias("total"), (total > 1).alias("ambiguous"), F.least(total, F.lit(options.max_matches)).alias("returned"), (total > options.max_matches).alias("truncated"), "hint")


def expanded(found: DataFrame, options: Options) -> DataFrame:
    """The candidates whose relationships are told: single ones, and the first of others if asked for."""
    return found.where((F.col("total") == 1) | F.lit(options.expand_ambiguous)).where(F.col("place") <= options.max_matches)


def build_relationships(graph: Graph, roots: DataFrame, depth: int, related: bool = False) -> DataFrame:
    """(root, section, node, distance) of what roots use and are used by, at once and further on, of the files that their
    file needs and serves, and of related symbols. Callers of a method are those of its family. Depth 0: nothing."""
    asked = checkpointed(roots.where(F.coalesce("id", F.lit("")) != "").select("id", "type", "file_path", "namespace").distinct())
    if depth == 0:
        return asked.limit(0).select(F.col("id").alias("root"), F.lit("").alias("section"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    is_head = F.coalesce(fold("type"), F.lit("")) == "METHOD"
    pairs = checkpointed(traverse.resolved(graph.edges.where(is_usage()), graph.nodes).select("source_id", "target_id").distinct())
    seeds = asked.select(F.col("id").alias("root"), F.col("id").alias("node"))
    uses = traverse.reach(seeds, pairs.toDF("at", "to"), depth)
    plain = traverse.reach(asked.where(~is_head).select(F.col("id").alias("root"), F.col("id").alias("node")), pairs.toDF("to", "at"), depth)
    used = plain.where("distance > 0").union(traverse.family_reach(graph.nodes, graph.edges, asked.where(is_head), depth))
    part = lambda df, near, far: df.where("distance > 0").select("root", F.when(F.col("distance") == 1, near).otherwise(far).alias("section"), "node", "distance")
    out = part(uses, "uses", "transitiveUses").union(part(used, "usedBy", "transitiveUsedBy"))
    of_file = asked.where("file_path <> ''").select(F.col("id").alias("root"), "file_path")
    for section, incoming in (("fileDependencies", False), ("fileDependents", True)):
        links = files.file_dependencies(graph.nodes, graph.edges, incoming)
        out = out.union(of_file.join(links, F.col("file_path") == F.col("file")).select("root", F.lit(section), F.col("other"), F.lit(1)))
    if related:
        out = out.union(files.related_items(graph.nodes, asked).select("root", F.lit("relatedItems"), "node", F.lit(1)))
    return out


def capped_relationships(graph: Graph, roots: DataFrame, options: Options) -> DataFrame:
    """(root, section, place, total, returned, truncated, node, name, type, file, line, distance, relations, occurrences,
    call_sites, lines): each section's first rows in its order, with totals. A section that a filter empties has one row
    with total 0; one that never had any has none."""
    every = checkpointed(build_relationships(graph, roots, options.depth, options.include_related))
    usage = traverse.resolved(graph.edges.where(is_usage()), graph.nodes)
    kept = resolve.relation_filter(usage, options.relation)
    members = traverse.method_family(graph.nodes, graph.edges, roots.where(F.coalesce(fold("type"), F.lit("")) == "METHOD"))
    target = members.union(roots.where(F.coalesce(fold("type"), F.lit("")) != "METHOD").select(F.col("id").alias("root"), F.col("id").alias("node"))).distinct()
    # Edges between a root (or, towards it, its family) and its direct neighbours.
    out_edges = traverse.occurrences(kept, "source_id", "target_id", options.max_call_sites).withColumn("section", F.lit("uses"))
    inward = kept.join(target.withColumnRenamed("node", "target_id"), "target_id").drop("target_id").withColumnRenamed("root", "target_id")
    in_edges = traverse.occurrences(inward, "target_id", "source_id", options.max_call_sites).withColumn("section", F.lit("usedBy"))
    direct = every.where("section in ('uses', 'usedBy')").join(out_edges.unionByName(in_edges), ["root", "section", "node"], "left")
    if options.relation:
        direct = direct.where("edge_count > 0")
    shape = ["root", "section", "node", "distance", "relations", "edge_count", "call_sites", "lines", "min_rank"]
    other = every.where("section not in ('uses', 'usedBy')")
    for name, kind in (("relations", "array<string>"), ("edge_count", "bigint"), ("call_sites", "int"), ("lines", "array<bigint>"), ("min_rank", "int")):
        other = other.withColumn(name, F.lit(None).cast(kind))
    about = graph.nodes.select(F.col("id").alias("node"), *compact_node(options.root_path), "file_path", "start_line", "start_col")
    rows = direct.select(shape).union(other.select(shape)).join(about, "node", "left")
    by_rank = [F.coalesce("min_rank", F.lit(5)), is_test_path().cast("int"), type_rank(), fold("file_path"), F.col("start_line")]
    first = [F.when(F.col("section").isin("uses", "usedBy"), k) for k in by_rank]
    order = Window.partitionBy("root", "section").orderBy("distance", *first, fold(F.coalesce("identifier", "node")), "node")
    own = Window.partitionBy("root", "section")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(own)).where(F.col("place") <= options.max_relationships)
    told = rows.withColumn("file", F.when(F.col("section").isin("fileDependencies", "fileDependents"), display_path("node", options.root_path)).otherwise(F.col("file")))
    columns = ["root", "section", "place", "total", F.least("total", F.lit(options.max_relationships)).alias("returned"), (F.col("total") > options.max_relationships).alias("truncated"), "node", "name", "type", "file", "line", "distance", "relations", F.col("edge_count").alias("occurrences"), "call_sites", "lines"]
    out = told.select(columns)
    empty = every.where("section in ('uses', 'usedBy')").select("root", "section").distinct().join(out.select("root", "section").distinct(), ["root", "section"], "left_anti")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in out.schema} | {"root": F.col("root"), "section": F.col("section"), "total": F.lit(0).cast("bigint"), "returned": F.lit(0).cast("bigint"), "truncated": F.lit(False)}
    return out.union(empty.select(*[blank[f.name].alias(f.name) for f in out.schema]))


@dataclass(frozen=True)
class Context:
    answers: DataFrame
    targets: DataFrame
    relationships: DataFrame


def compact_context(graph: Graph, requests: DataFrame, options: Options | None = None) -> Context:
    """Answers to requests (req, query): a row each, the targets that are told, and the relationships of expanded ones."""
    options = options or Options()
    found = checkpointed(ranked(resolve.find_candidates(graph.nodes, requests, options.exact, **options.filters())))
    told = found.where(F.col("place") <= options.max_matches)
    targets = told.select("req", "place", "id", *compact_node(options.root_path))
    roots = checkpointed(expanded(found, options).select("req", "place", *graph.nodes.columns))
    sections = capped_relationships(graph, roots.select(graph.nodes.columns).distinct(), options)
    linked = roots.select("req", F.col("place").alias("target"), F.col("id").alias("root")).join(sections, "root")
    return Context(answers(requests, found, graph.nodes, options), targets, linked)


def full_context(graph: Graph, requests: DataFrame, options: Options) -> Context:
    """All candidates, by part of a name unless exact is asked for, none ranked away, each with all its relationships."""
    options = Options(**{**options.__dict__, "exact": bool(options.exact), "full": True, "expand_ambiguous": True, "max_matches": 50})
    found = checkpointed(ranked(resolve.find_candidates(graph.nodes, requests, options.exact, **options.filters())))
    rows = build_relationships(graph, found.select(graph.nodes.columns).distinct(), options.depth, options.include_related)
    hints = no_match_hint(requests, found, graph.nodes, options).union(disambiguation_hint(found.where("match_mode <> 'filePath'")))
    linked = found.select("req", F.col("place").alias("target"), F.col("id").alias("root")).join(rows, "root")
    return Context(requests.select("req").join(hints, "req", "left"), found.select("req", "place", "id", *compact_node(options.root_path)), linked)


def agent_lines(context: Context, requests: DataFrame) -> DataFrame:
    """(req, ord, line): a tab-separated rendering, the lines of a request in the order of ord."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ")
    place = lambda *x: F.array(*[F.col(c) if isinstance(c, str) else F.lit(c).cast("bigint") for c in x]).cast("array<bigint>")
    cut = lambda c: F.when(c, "\ttruncated").otherwise("")
    a = context.answers.join(requests.select("req", "query"), "req")
    missing = a.where("total = 0").select("req", place(0).alias("ord"), F.concat(F.lit("missing\t"), clean(F.col("query"))).alias("line"))
    said = a.where("total > 0 and (ambiguous or truncated or match_mode <> 'exact')")
    matches = said.select("req", place(0), F.concat(F.lit("matches\t"), "returned", F.lit("/"), "total", F.lit("\t"), "match_mode", cut(F.col("truncated"))))
    hint = said.where("trim(coalesce(hint, '')) <> ''").select("req", place(1), F.concat(F.lit("hint\t"), clean(F.col("hint"))))
    at = F.concat_ws(":", "file", F.col("line").cast("string"))
    target = context.targets.select("req", place(2, "place", 0), F.concat_ws("\t", F.lit("target"), clean(F.col("identifier")), clean(F.coalesce("type", F.lit("Unknown"))), F.when(F.col("file").isNotNull(), at), F.when(F.col("signature") != "", clean(F.col("signature")))))
    sections = ["uses", "usedBy", "transitiveUses", "transitiveUsedBy", "fileDependencies", "fileDependents", "relatedItems"]
    r = context.relationships.withColumn("s", F.array_position(F.array(*map(F.lit, sections)), F.col("section")))
    heads = r.select("req", "target", "s", "section", "returned", "total", "truncated").distinct().where("total > 0 or truncated")
    head = heads.select("req", place(2, "target", "s", 0), F.concat("section", F.lit("\t"), "returned", F.lit("/"), "total", cut(F.col("truncated"))))
    kinds = F.when(F.size("relations") > 0, F.array_join("relations", ",")).otherwise("-")
    node = F.concat_ws("\t", F.lit(""), kinds, clean(F.coalesce("name", "node")), "type", F.when(F.col("file").isNotNull(), at))
    body = r.where("place is not null").select("req", place(2, "target", "s", "place"), F.when(F.col("section").startswith("file"), F.concat(F.lit("\t"), "file")).otherwise(node))
    alone = context.targets.select("req", F.col("place").alias("target")).join(heads.select("req", "target").distinct(), ["req", "target"], "left_anti")
    alone = alone.select("req", place(2, "target", 1), F.lit("relationships\tnone"))
    return missing.union(matches).union(hint).union(target).union(head).union(body).union(alone)


def as_json(context: Context) -> DataFrame:
    """(req, json): an answer with its targets as one document; nulls and false flags left out."""
    t = context.targets.groupBy("req").agg(F.array_sort(F.collect_list(F.struct("place", "name", "type", "file", "line", "signature", "identifier"))).alias("targets"))
    a = context.answers.join(t, "req", "left")
    own = F.transform("targets", lambda x: F.struct(*[x[c].alias(c) for c in ("name", "type", "file", "line", "signature", "identifier")]))
    said = F.struct("match_mode", F.when(F.col("substring_skipped"), True).alias("substring_skipped"), "total", F.when(F.col("ambiguous"), True).alias("ambiguous"), "returned", F.when(F.col("truncated"), True).alias("truncated"), "hint", own.alias("targets"))
    return a.select("req", F.to_json(said, {"ignoreNullFields": "true"}).alias("json"))
