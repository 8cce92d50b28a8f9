"""Which tests bear witness to a symbol, and how.

Graph evidence comes from one walk that starts at the test methods, which are few, and follows usage edges forwards
without paths; a root's distance to a test is the least over its family's members. Evidence by name is a search for
names inside names: every part of a test's text that is as long as some root's name is looked up by an equi-join, so no
root meets a test that it doesn't share text with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expr import CONTAINMENT, fold, is_test_method, is_test_path, is_usage, path_key
from weftgraph.operators.resolve import parts_found
from weftgraph.operators.traverse import families, heads_of, members_of, reach, resolved
from weftgraph.plans.staging import checkpointed

DEPTH, HEURISTIC_NODES = 5, 10
FILES, METHODS = 5, 5  # told of a root, and of each of these
CALLS = "type in ('CALLS', 'MOCK_CALLS')"


def test_symbols(nodes: DataFrame) -> DataFrame:
    """Symbols in test files: (id, name, signature, kind, is_method, key, file); files whose paths differ by case are one,
    shown by the smallest."""
    own = nodes.where(is_test_path() & (F.coalesce("file_path", F.lit("")) != ""))
    own = own.select("id", "name", "signature", fold("type").alias("kind"), is_test_method().alias("is_method"), "start_line", path_key("file_path").alias("key"), "file_path")
    return own.join(own.groupBy("key").agg(F.min("file_path").alias("file")), "key").drop("file_path")


def _row(root: str, tag: Column, method: Column | None = None, source: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [F.col(root).alias("root"), "key", "file", tag.alias("evidence"), (none if method is None else method).alias("method"), (none if source is None else source).alias("source")]


def graph_evidence(nodes: DataFrame, edges: DataFrame, roots: DataFrame, tests: DataFrame, depth: int = DEPTH, members: int | None = None) -> DataFrame:
    """(root, key, file, evidence, method, source) of what edges say. ``members``: how many members of a type are looked
    at for calls, the first by edge id; None for all."""
    roots = roots.where(F.coalesce("name", F.lit("")) != "").select("id", (F.coalesce(fold("type"), F.lit("")) == "METHOD").alias("is_head"))
    usage = checkpointed(resolved(edges.where(is_usage()), nodes).select("source_id", "target_id", "type"))
    family = families(nodes, edges)
    heads = checkpointed(heads_of(roots.where("is_head"), family))
    member = checkpointed(members_of(heads, family))
    others = roots.where("not is_head")
    target = heads.join(member, "head").select("root", F.col("node").alias("target_id")).union(others.select(F.col("id").alias("root"), F.col("id").alias("target_id")))
    by_source = tests.withColumnRenamed("id", "source_id")
    seen = checkpointed(usage.join(by_source, "source_id").select("source_id", "target_id", "type", "is_method", "key", "file")).join(target, "target_id")
    first = seen.select(*_row("root", F.when(F.col("type") == "IMPLEMENTS", "testImplementer").otherwise("testReference"), source=F.col("source_id")))
    calls = seen.where(f"is_method and {CALLS}").select(*_row("root", F.when(F.col("target_id") == F.col("root"), "directCall").otherwise("potentialDispatch"), F.col("source_id")))
    inside = edges.where(fold("type").isin(*CONTAINMENT) & (F.coalesce("target_id", F.lit("")) != "")).select(F.col("source_id").alias("id"), F.col("target_id").alias("member"), F.col("id").alias("edge"))
    inside = others.join(inside, "id").groupBy("id", "member").agg(F.min("edge").alias("edge"))
    if members is not None:
        inside = inside.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("edge"))).where(F.col("n") <= members)
    called = usage.where(CALLS).join(by_source.where("is_method"), "source_id")
    inner = inside.join(called, F.col("member") == F.col("target_id")).select(*_row("id", F.lit("memberCall"), F.col("source_id")))
    pairs = checkpointed(usage.select(F.col("source_id").alias("at"), F.col("target_id").alias("to")).distinct())
    methods = tests.where("is_method")
    walked = reach(methods.select(F.col("id").alias("root"), F.col("id").alias("node")), pairs, depth).where("distance > 0")
    walked = walked.select(F.col("root").alias("test"), "node", "distance")
    own = walked.join(others, F.col("node") == F.col("id")).select(F.col("node").alias("root"), "test", "distance")
    of_family = walked.join(member, "node").groupBy("head", "test").agg(F.min("distance").alias("distance"))
    of_family = of_family.join(member.withColumnRenamed("node", "test"), ["head", "test"], "left_anti")
    reached = own.union(heads.join(of_family, "head").select("root", "test", "distance")).join(methods, F.col("test") == F.col("id"))
    far = reached.select(*_row("root", F.when(F.col("distance") == 1, "testReference").otherwise("indirectReference"), F.col("test"), F.when(F.col("distance") >= 1, F.col("test"))))
    return first.union(calls).union(inner).union(far).distinct()


def _named(nodes: DataFrame) -> DataFrame:
    """(root, low, key2): lower-cased names, and what follows "test" once words of action are taken out one by one."""
    low = F.lower("name")
    short = low
    for verb in ("get", "set", "create", "update", "delete"):
        short = F.replace(short, F.lit(verb), F.lit(""))
    return nodes.where(F.coalesce("name", F.lit("")) != "").select(F.col("id").alias("root"), low.alias("low"), F.concat(F.lit("test"), short).alias("short"))


def naming(tests: DataFrame, roots: DataFrame, nodes_at_most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((root, key, file) of test files that may hold tests of a root by their names or methods; (root, key, file, method)
    of the test methods of any test file that do). ``nodes_at_most``: how many symbols of such files are looked at, in the
    order of files; None for all."""
    named = checkpointed(_named(roots))
    names = checkpointed(named.select("low", "short").distinct())
    name = F.lower(F.regexp_extract("key", r"([^/]*)$", 1))
    methods = tests.where("is_method and kind = 'METHOD'").select("id", "key", "file", F.lower("name").alias("name"), F.lower("signature").alias("signature"))
    files = checkpointed(tests.groupBy("key", "file").agg(F.count("*").alias("n")).select("key", "file", "n", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem")))
    methods = checkpointed(methods)
    texts = files.select(F.col("name").alias("text")).union(files.select("stem")).union(methods.select("name")).union(methods.select("signature")).where("text <> ''")
    found = checkpointed(parts_found(texts, names.select(F.col("low").alias("name")).union(names.select("short"))))
    has = lambda df, text, *keep: df.join(found.withColumnRenamed("name", "part"), F.col(text) == F.col("text")).select(*keep, "part")
    low = lambda df, *keep: df.join(names.select(F.col("low").alias("part")).distinct(), "part").select(*keep, F.col("part").alias("low"))
    by_file = low(has(files, "name", "key", "file"), "key", "file")
    by_stem = low(has(files, "stem", "key"), "key")
    of = ("id", "key", "file")
    by_name = has(methods, "name", *of)
    by_method = low(by_name, *of).union(by_name.join(names, F.col("part") == F.col("short")).select(*of, "low")).union(low(has(methods, "signature", *of), *of))
    by_method = checkpointed(by_method.union(methods.join(by_stem, "key").select(*of, "low")).distinct())
    near = by_file.select("low", "key", "file").union(by_method.select("low", "key", "file")).distinct()
    if nodes_at_most is not None:
        before = Window.partitionBy("low").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        near = near.join(files.select("key", "n"), "key").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < nodes_at_most)
    return named.join(near, "low").select("root", "key", "file"), named.join(by_method, "low").select("root", "key", "file", F.col("id").alias("method"))


def evidence(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = DEPTH, members: int | None = None, heuristic_nodes: int | None = None) -> DataFrame:
    """(root, file, evidence, method, source): a row per root, test file, tag and test method (null where a file speaks as a
    whole). Methods that only their names or their file's name speak for have the tag ``heuristicMethod``."""
    tests = checkpointed(test_symbols(nodes))
    graph = checkpointed(graph_evidence(nodes, edges, roots, tests, depth, members))
    files, methods = naming(tests, roots, heuristic_nodes)
    named = files.select(*_row("root", F.lit("namingHeuristic")))
    witnessed = graph.select("root", "key").union(files.select("root", "key")).distinct()
    new = methods.join(witnessed, ["root", "key"], "left_semi").join(graph.where("method is not null").select("root", "key", "method"), ["root", "key", "method"], "left_anti")
    return checkpointed(graph.union(named).union(new.select(*_row("root", F.lit("heuristicMethod"), F.col("method")))).drop("key").distinct())


def summary(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root: is it tested, directly, by how many references, implementers and names."""
    n = found.groupBy("root").agg(
        F.bool_or(F.col("evidence").isin("directCall", "memberCall")).alias("directly_tested"),
        F.count_distinct(F.when((F.col("evidence").isin("testReference", "indirectReference")) & F.col("source").isNotNull(), F.col("source"))).alias("references"),
        F.count_distinct(F.when(F.col("evidence") == "testImplementer", F.col("source"))).alias("implementers"),
        F.count_distinct(F.when(F.col("evidence") == "heuristicMethod", F.struct("file", "method"))).alias("heuristics"),
        F.count_distinct("file").alias("files"),
    )
    return summed(n, roots)


def summed(n: DataFrame, roots: DataFrame) -> DataFrame:
    """The same of roots with counts (root, directly_tested, references, implementers, heuristics, files)."""
    out = roots.select(F.col("id").alias("root")).join(n.hint("merge"), "root", "left")  # a row per root is no broadcast
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("references", "implementers", "heuristics", "files")]
    out = out.select("root", F.coalesce("directly_tested", F.lit(False)).alias("directly_tested"), *zero)
    return out.withColumn("is_tested", F.col("directly_tested") | (F.col("references") > 0) | (F.col("implementers") > 0) | (F.col("heuristics") > 0))


def test_files(found: DataFrame, methods: DataFrame, root_path: str = "", most_files: int = FILES, most_methods: int = METHODS) -> DataFrame:
    """(root, file, evidence, method, place, test_count, file_place, file_count): the first files of each root by path and
    the first methods of each by line, with totals. ``methods``: nodes with id and start_line."""
    each = found.groupBy("root", "file").agg(F.array_sort(F.collect_set(F.when(F.col("evidence") != "heuristicMethod", F.col("evidence")))).alias("evidence"), F.count_distinct("method").alias("test_count"))
    of_root = Window.partitionBy("root")
    each = each.withColumn("file_place", F.row_number().over(of_root.orderBy(fold("file"), "file"))).withColumn("file_count", F.count("*").over(of_root)).where(F.col("file_place") <= most_files)
    own = found.where("method is not null").select("root", "file", "method").distinct().join(methods.select(F.col("id").alias("method"), "start_line").hint("merge"), "method")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("root", "file").orderBy("start_line", "method"))).where(F.col("place") <= most_methods)
    return each.join(own.drop("start_line").hint("merge"), ["root", "file"], "left")
