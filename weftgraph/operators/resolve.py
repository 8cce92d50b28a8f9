"""From a request to ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expr import LANGUAGES, RELATIONS, containing_type, fold, is_test_path, path_key, shown, type_rank

#: So many names at most go to every task instead of being met by a sort.
FEW_NAMES = 10_000


def match_exact(nodes: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    out = nodes.where(fold("name") == F.upper(F.lit(name)))
    return out.where(fold("type") == F.upper(F.lit(kind))) if kind else out


def match_substring(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(fold("name").contains(F.upper(F.lit(text))))


def lookup(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Nodes of keys (key), by id or by identifier."""
    by = lambda c: keys.select("key").join(nodes, F.col("key") == F.col(c)).select("key", *nodes.columns)
    return by("id").union(by("identifier")).dropDuplicates(["key", "id"])


def edges_of(edges: DataFrame, keys: DataFrame, end: str, kind: str | None = None) -> DataFrame:
    """Edges that leave (end source_id) or reach (target_id) the nodes of keys (key), of one type if asked, its case as given."""
    own = edges if kind is None else edges.where(F.col("type") == kind)
    return keys.select("key").join(own, F.col("key") == F.col(end))


def parts_found(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (text, name) of which the text holds the name. Every part of a text that is as long as some name is looked
    up by an equi-join, so no name meets a text that it isn't in; a row per distinct length of a name goes through the driver."""
    names = names.where("name <> ''")
    counts = {r[0]: r["count"] for r in names.groupBy(F.char_length("name")).count().collect()}
    lengths = list(counts)
    size = F.char_length("text")
    own = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= size)
    parts = F.flatten(F.transform(own, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.col("text").substr(i, n))))
    cut = texts.distinct().select("text", F.explode(F.array_distinct(parts)).alias("name"))
    # Spark takes texts and their parts, which are hundreds of times as many rows, for equally large, so it might send the parts to the driver.
    wanted = names.distinct()
    met = cut.join(F.broadcast(wanted), "name") if sum(counts.values()) <= FEW_NAMES else cut.hint("merge").join(wanted, "name")
    return met.select("text", "name")


def match_cascade(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (req, query) the nodes of the first tier that has any: identity, exact name, substring. All
    three are equi-joins; the last runs only for requests that the others haven't answered."""
    asked = requests.select("req", "query")
    identity = asked.join(nodes, F.col("query") == F.col("identifier")).withColumn("match_mode", F.lit("identity"))
    rest = asked.join(identity.select("req").distinct(), "req", "left_anti")
    exact = rest.join(nodes, fold("query") == fold("name")).withColumn("match_mode", F.lit("exact"))
    rest = rest.join(exact.select("req").distinct(), "req", "left_anti")
    return identity.unionByName(exact).unionByName(match_parts(nodes, rest).withColumn("match_mode", F.lit("substring")))


def match_parts(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, query, and the node) of nodes whose names hold a request's text, whatever the case."""
    found = parts_found(nodes.select(fold("name").alias("text")).where("text <> ''"), requests.select(fold("query").alias("name")))
    out = requests.select("req", "query").join(found, fold("query") == found["name"]).select("req", "query", "text")
    return out.join(nodes, F.col("text") == fold("name")).drop("text")


def match_paths(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """The same of nodes whose file a request names: a rooted path whole, another whole or after a slash. Nodes offer
    each of their path's ends."""
    wanted = requests.select("req", "query", path_key("query").alias("key"), F.col("query").startswith("/").alias("rooted"))
    parts = F.split("p", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("key"), (i == 1).alias("whole")))
    files = nodes.where("file_path <> ''").select(path_key("file_path").alias("p")).distinct().select("p", F.explode(ends).alias("x")).select("p", "x.*")
    met = wanted.join(files, "key").where("whole or not rooted").select("req", "query", "p").distinct()
    return met.join(nodes, F.col("p") == path_key("file_path")).drop("p")


def is_file_path(text: Column, extensions: tuple[str, ...] = tuple(LANGUAGES)) -> Column:
    """Text that names a file rather than a symbol: it has a slash, or an extension that a language owns."""
    return text.contains("/") | text.contains("\\") | F.lower(F.regexp_extract(text, r"\.([^./\\]*)$", 1)).isin(*extensions)


def find_candidates(nodes: DataFrame, requests: DataFrame, exact: bool | None = None, **filters: str | None) -> DataFrame:
    """(req, query, match_mode, and the node): an identity first, and only it, though a filter may reject it; then paths;
    then names, exactly or by part (exact None: by part where no name is exact). Filters hold at every step."""
    asked = requests.select("req", "query")
    known = asked.join(nodes, F.col("query") == F.col("identifier"))
    rest = asked.join(known.select("req").distinct(), "req", "left_anti")
    paths, names = rest.where(is_file_path(F.col("query"))), rest.where(~is_file_path(F.col("query")))
    own = candidate_filters(nodes, **filters)
    out = candidate_filters(known, **filters).withColumn("match_mode", F.lit("identity"))
    out = out.unionByName(match_paths(own, paths).withColumn("match_mode", F.lit("filePath")))
    if exact is not False:
        same = names.join(own, fold("query") == fold("name"))
        out = out.unionByName(same.withColumn("match_mode", F.lit("exact")))
        names = names.join(same.select("req").distinct(), "req", "left_anti")
    if not exact:
        out = out.unionByName(match_parts(own, names).withColumn("match_mode", F.lit("substring")))
    return out


def candidate_filters(nodes: DataFrame, kind: str | None = None, containing: str | None = None, namespace: str | None = None, signature: str | None = None, file: str | None = None) -> DataFrame:
    same = lambda c, v: fold(c) == F.upper(F.lit(v))
    for value, test in ((kind, "type"), (namespace, "namespace"), (signature, "signature")):
        if value is not None:
            nodes = nodes.where(same(test, value))
    if containing is not None:
        nodes = nodes.where(same(containing_type(), containing))
    return nodes_by_path(nodes, file) if file is not None else nodes


def nodes_by_path(nodes: DataFrame, path: str) -> DataFrame:
    """Rooted paths match whole; relative ones match whole or as a suffix after a slash. Case is ignored."""
    wanted = path.replace("\\", "/").rstrip("/")
    key, low = path_key("file_path"), F.upper(F.lit(wanted))
    if path.startswith("/"):
        return nodes.where(key == low)
    return nodes.where((key == low) | key.endswith(F.concat(F.lit("/"), low)))


def candidate_order(query: Column) -> list[Column]:
    """Exact names first, tests last, then by kind, path and line; identifier and id make the order total."""
    return [F.when(fold("name") == F.upper(query), 0).otherwise(1), is_test_path().cast("int"), type_rank(), fold("file_path"), F.col("start_line"), F.col("identifier"), F.col("id")]


def topk_with_totals(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each group with the group's total and whether it was cut. Totals are counted apart and joined to the
    few rows that stay, so Spark cuts groups to k rows before it shuffles them: a group of any size is no task of its own."""
    first = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    total = df.groupBy(*group).agg(F.count("*").alias("total"))
    return first.join(total, group).withColumn("truncated", F.col("total") > k)


def facets(candidates: DataFrame, root: str, most: int = 10) -> DataFrame:
    """(facet, value, n, place, total): counts by type and by display path, ignoring case; paths are the first `most` by
    count, total says how many there are."""
    from weftgraph.functions.expr import display_path

    kinds = candidates.select(F.lit("type").alias("facet"), F.coalesce("type", F.lit("Unknown")).alias("v"))
    paths = candidates.select(F.lit("file").alias("facet"), display_path("file_path", root).alias("v"))
    paths = paths.where("v <> ''")
    n = kinds.union(paths).groupBy("facet", fold("v").alias("key")).agg(F.min("v").alias("value"), F.count("*").alias("n"))
    own = Window.partitionBy("facet")
    out = n.withColumn("place", F.row_number().over(own.orderBy(F.desc("n"), "key"))).withColumn("total", F.count("*").over(own))
    return out.where((F.col("facet") == "type") | (F.col("place") <= most)).select("facet", "value", "n", "place", "total")


def relation_kinds(relation: str | None) -> list[str] | None:
    """The kinds of a comma-separated filter, None for no filter; unknown ones raise."""
    wanted = [x.strip().upper() for x in (relation or "").split(",") if x.strip()]
    if bad := [x for x in wanted if x not in RELATIONS]:
        raise ValueError(f"unknown relation {', '.join(bad)}; known are {', '.join(RELATIONS)}")
    return wanted or None


def relation_filter(edges: DataFrame, relation: str | None) -> DataFrame:
    kinds = relation_kinds(relation)
    return edges.where(fold(shown()).isin(kinds)) if kinds else edges


def summarize_types(candidates: DataFrame, most: int = 3) -> DataFrame:
    n = candidates.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "type").limit(most)  # the feature: a top list
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "type")))
    return top.agg(F.array_join(F.transform(rows, lambda x: F.concat(x["type"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), ", ").alias("summary"))
