"""Every operator of the graph engine as a query over the star schema's graph, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import expr as X
from weftgraph.operators import commit, context, evidence, files, lifecycle, relations, resolve, stats, traverse, walks, witness
from weftgraph.plans.adapter import EDGES_SQL, NODES_SQL, Graph, star_graph
from weftgraph.plans.staging import checkpointed
from weftgraph.sources import facts, ignore
from weftgraph.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

GRAPH = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"
USAGE = "(type IS NULL OR upper(type) NOT IN ('HAS_METHOD','HAS_PROPERTY','HAS_FIELD','CONTAINS','IMPLEMENTS_MEMBER','OVERRIDES_MEMBER'))"
KIN = "upper(type) IN ('IMPLEMENTS_MEMBER','OVERRIDES_MEMBER')"
SEMANTIC = "upper(type) IN ('CALLS','MOCK_CALLS','REFERENCES','IMPLEMENTS','INHERITS','EXTENDS','IMPORTS','IMPLEMENTS_MEMBER','OVERRIDES_MEMBER')"
RESOLVED = "source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)"
TYPE_RANK = "CASE upper(type) WHEN 'CLASS' THEN 0 WHEN 'INTERFACE' THEN 1 WHEN 'METHOD' THEN 2 WHEN 'PROPERTY' THEN 3 ELSE 4 END"
REL_RANK = "CASE upper(coalesce(type,'USES')) WHEN 'IMPLEMENTS' THEN 0 WHEN 'INHERITS' THEN 1 WHEN 'EXTENDS' THEN 1 WHEN 'CALLS' THEN 2 WHEN 'REFERENCES' THEN 3 WHEN 'USES' THEN 3 WHEN 'IMPORTS' THEN 4 ELSE 5 END"
TEST_PATH = "(upper(file_path) LIKE '%TEST%' OR upper(file_path) LIKE '%SPEC%')"
TEST_METHOD = "(name <> '' AND (lower(is_test) = 'true' OR regexp_matches(lower(name), '^(test|should|can|given|when|then)|tests?$|_should_') OR contains(lower(signature), '[test') OR contains(lower(signature), '[fact') OR contains(lower(signature), '[theory')))"
NAME = "(SELECT min(name) FROM nodes WHERE type = 'Property')"


def query(sql: str | None = None, graph: bool = True, keep: bool = False, distinct: bool = True) -> Callable:
    """Register a function of (graph) or of (spark, sf_dir) under its name, with the SQL after the graph's CTEs.
    keep: materialise the graph first, for plans that read it many times. distinct: as star_graph."""

    def made(spark: SparkSession, sf: str) -> Graph:
        g = star_graph(spark, sf, distinct)
        return Graph(checkpointed(g.nodes), checkpointed(g.edges)) if keep else g

    def register(f: Callable) -> Callable:
        _queries[f.__name__] = (lambda spark, sf: f(made(spark, sf))) if graph else f
        if sql is not None:
            _sql[f.__name__] = f"{GRAPH}{sql}" if sql.lstrip().startswith(",") else f"{GRAPH} {sql}" if graph else sql
        return f

    return register


def _first_part(g: Graph) -> str:
    return g.nodes.where("type = 'Property'").agg(F.min("name")).first()[0] or ""


def _heads(g: Graph) -> DataFrame:
    """All methods, as roots."""
    return g.nodes.where("type = 'Method'")


@query(f"SELECT id, name, type FROM nodes WHERE upper(name) = upper({NAME})")
def match_exact(g: Graph) -> DataFrame:
    return resolve.match_exact(g.nodes, _first_part(g)).select("id", "name", "type")


@query("SELECT id, name FROM nodes WHERE contains(upper(name), 'RING')")
def match_substring(g: Graph) -> DataFrame:
    return resolve.match_substring(g.nodes, "ring").select("id", "name")


@query(f""", requests AS (SELECT 1 AS req, 'ship:part/7' AS query UNION ALL SELECT 2, {NAME} UNION ALL SELECT 3, 'ring' UNION ALL SELECT 4, 'nothing like it'),
m AS (SELECT req, id, CASE WHEN query = identifier THEN 0 WHEN upper(query) = upper(name) THEN 1 ELSE 2 END AS tier FROM requests JOIN nodes ON query = identifier OR upper(query) = upper(name) OR contains(upper(name), upper(query)))
SELECT req, id, CASE tier WHEN 0 THEN 'identity' WHEN 1 THEN 'exact' ELSE 'substring' END AS match_mode FROM m JOIN (SELECT req, min(tier) AS tier FROM m GROUP BY req) t USING (req, tier)""")
def match_cascade(g: Graph) -> DataFrame:
    spark = g.nodes.sparkSession
    asked = spark.createDataFrame([(1, "ship:part/7"), (2, _first_part(g)), (3, "ring"), (4, "nothing like it")], "req int, query string")
    return resolve.match_cascade(g.nodes, asked).select("req", "id", "match_mode")


@query("SELECT id FROM nodes WHERE upper(type) = 'CLASS' AND upper(namespace) = 'BUILDING' AND (upper(file_path) = 'CUSTOMER7.CS' OR upper(file_path) LIKE '%/CUSTOMER7.CS')")
def candidate_filters(g: Graph) -> DataFrame:
    return resolve.candidate_filters(g.nodes, kind="class", namespace="building", file="customer7.cs").select("id")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN upper(name) = 'RING' THEN 0 ELSE 1 END, {TEST_PATH}, {TYPE_RANK}, upper(file_path), start_line, identifier, id) AS INTEGER) AS rank FROM nodes WHERE contains(upper(name), 'RING') ORDER BY rank LIMIT 50")
def rank_candidates(g: Graph) -> DataFrame:
    found = resolve.match_substring(g.nodes, "ring").orderBy(*resolve.candidate_order(F.lit("ring"))).limit(50)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*resolve.candidate_order(F.lit("ring"))))).select("id", "rank")


@query(""", v AS (SELECT 'type' AS facet, coalesce(type, 'Unknown') AS v FROM nodes UNION ALL SELECT 'file', CASE WHEN starts_with(file_path, '/wh/') THEN substr(file_path, 5) ELSE file_path END FROM nodes),
c AS (SELECT facet, min(v) AS value, count(*) AS n, count(*) OVER (PARTITION BY facet) AS total, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, upper(v)) AS place FROM v GROUP BY facet, upper(v))
SELECT facet, value, CAST(n AS BIGINT) AS n, CAST(place AS INTEGER) AS place, CAST(total AS BIGINT) AS total FROM c WHERE facet = 'type' OR place <= 10""")
def facets(g: Graph) -> DataFrame:
    return resolve.facets(g.nodes, "/wh")


@query("SELECT string_agg(concat(type, ' (', n, ')'), ', ' ORDER BY n DESC, type) AS summary FROM (SELECT coalesce(type, 'Unknown') AS type, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, type LIMIT 3) x")
def summarize_types(g: Graph) -> DataFrame:
    return resolve.summarize_types(g.nodes)


@query("SELECT id, file_path FROM nodes WHERE upper(file_path) = 'TESTS/ORDERTESTS7.CS' OR upper(file_path) LIKE '%/TESTS/ORDERTESTS7.CS'")
def nodes_by_path(g: Graph) -> DataFrame:
    return resolve.nodes_by_path(g.nodes, "tests\\ordertests7.cs").select("id", "file_path")


@query("SELECT id, target_id, type FROM edges WHERE source_id = 'tpch:default:orders/7'")
def edges_by_source(g: Graph) -> DataFrame:
    return g.edges.where("source_id = 'tpch:default:orders/7'").select("id", "target_id", "type")


@query("SELECT id, source_id FROM edges WHERE target_id = 'ship:default:supplier/7' AND type = 'IMPORTS'")
def edges_by_target(g: Graph) -> DataFrame:
    return g.edges.where("target_id = 'ship:default:supplier/7' and type = 'IMPORTS'").select("id", "source_id")


@query("SELECT e.id, e.type, n.id AS far, n.type AS far_type FROM edges e JOIN nodes n ON e.target_id = n.id")
def edge_node_join(g: Graph) -> DataFrame:
    far = g.nodes.select(F.col("id").alias("far"), F.col("type").alias("far_type"))
    return g.edges.join(far, F.col("target_id") == F.col("far")).select("id", "type", "far", "far_type")


@query(f"SELECT id, {TEST_PATH} AS is_test_path FROM nodes")
def is_test_path(g: Graph) -> DataFrame:
    return g.nodes.select("id", X.is_test_path().alias("is_test_path"))


@query(f"SELECT id FROM nodes WHERE {TEST_METHOD}")
def is_test_method(g: Graph) -> DataFrame:
    return g.nodes.where(X.is_test_method()).select("id")


@query(f"SELECT {USAGE} AS is_usage, {SEMANTIC} IS TRUE AS is_semantic, type, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY ALL")
def edge_classes(g: Graph) -> DataFrame:
    return g.edges.groupBy(X.is_usage().alias("is_usage"), X.is_semantic().alias("is_semantic"), "type").agg(F.count("*").alias("n"))


@query("SELECT id, coalesce(type, 'USES') AS type FROM edges WHERE upper(coalesce(type, 'USES')) IN ('CALLS', 'USES')")
def relation_filter(g: Graph) -> DataFrame:
    return resolve.relation_filter(g.edges, "calls, USES,").select("id", X.shown().alias("type"))


def _direct(incoming: bool) -> str:
    near, far = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    return f"SELECT DISTINCT {near} AS root, {far} AS node FROM edges WHERE {USAGE} AND {RESOLVED} AND source_id <> target_id"


@query(_direct(False))
def direct_uses(g: Graph) -> DataFrame:
    usage = traverse.resolved(g.edges.where(X.is_usage()), g.nodes).where("source_id <> target_id")
    return usage.select(F.col("source_id").alias("root"), F.col("target_id").alias("node")).distinct()


@query(_direct(True))
def direct_used_by(g: Graph) -> DataFrame:
    usage = traverse.resolved(g.edges.where(X.is_usage()), g.nodes).where("source_id <> target_id")
    return usage.select(F.col("target_id").alias("root"), F.col("source_id").alias("node")).distinct()


@query(f""", u AS (SELECT * FROM edges WHERE {USAGE} AND {RESOLVED})
SELECT target_id AS root, source_id AS node, CAST(count(*) AS BIGINT) AS edge_count, CAST(coalesce(len(list_distinct(list(line) FILTER (line IS NOT NULL))), 0) AS BIGINT) AS call_sites,
  coalesce(array_to_string(list_slice(list_sort(list_distinct(list(line + 1) FILTER (line IS NOT NULL))), 1, 3), ','), '') AS lines, CAST(min({REL_RANK}) AS INTEGER) AS min_rank
FROM u GROUP BY 1, 2""")
def edge_occurrences(g: Graph) -> DataFrame:
    usage = traverse.resolved(g.edges.where(X.is_usage()), g.nodes)
    out = traverse.occurrences(usage, "target_id", "source_id", 3)
    return out.select("root", "node", "edge_count", F.col("call_sites").cast("long").alias("call_sites"), F.array_join("lines", ",").alias("lines"), "min_rank")


_RELATED = f""", u AS (SELECT target_id AS root, source_id AS node, min({REL_RANK}) AS min_rank FROM edges WHERE {USAGE} AND {RESOLVED} GROUP BY 1, 2),
r AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY min_rank, {TEST_PATH}, {TYPE_RANK}, upper(file_path), start_line, identifier) AS rank, count(*) OVER (PARTITION BY root) AS total FROM u JOIN nodes ON node = id)
SELECT root, node, CAST(rank AS INTEGER) AS rank, CAST(total AS BIGINT) AS total, total > 10 AS truncated FROM r WHERE rank <= 10"""


@query(_RELATED)
def rank_related(g: Graph) -> DataFrame:
    """The flagship: who uses each symbol, ranked, the first ten with honest totals."""
    usage = traverse.resolved(g.edges.where(X.is_usage()), g.nodes)
    found = usage.groupBy(F.col("target_id").alias("root"), F.col("source_id").alias("node")).agg(F.min(X.relation_rank()).alias("min_rank"))
    near = found.join(g.nodes.withColumnRenamed("id", "node"), "node")
    order = [F.col("min_rank"), X.is_test_path().cast("int"), X.type_rank(), X.fold("file_path"), F.col("start_line"), F.col("identifier")]
    return resolve.topk_with_totals(near, ["root"], order, 10).select("root", "node", "rank", "total", "truncated")


@query(f""", r AS (SELECT target_id AS root, id, row_number() OVER (PARTITION BY target_id ORDER BY coalesce(type, ''), line NULLS FIRST, id) AS rank, count(*) OVER (PARTITION BY target_id) AS total FROM edges WHERE {USAGE})
SELECT root, id, CAST(rank AS INTEGER) AS rank, CAST(total AS BIGINT) AS total, total > 3 AS truncated FROM r WHERE rank <= 3""")
def topk_with_totals(g: Graph) -> DataFrame:
    order = [F.coalesce("type", F.lit("")), F.col("line").asc_nulls_first(), F.col("id")]
    found = resolve.topk_with_totals(g.edges.where(X.is_usage()).withColumnRenamed("target_id", "root"), ["root"], order, 3)
    return found.select("root", "id", "rank", "total", "truncated")


def _links(incoming: bool) -> str:
    a, b = ("t", "s") if incoming else ("s", "t")
    return f"""SELECT {a}.file_path AS file, min({b}.file_path) AS other FROM edges e JOIN nodes s ON e.source_id = s.id JOIN nodes t ON e.target_id = t.id
WHERE {SEMANTIC.replace('type', 'e.type')} AND s.file_path <> '' AND t.file_path <> '' AND upper(s.file_path) <> upper(t.file_path) GROUP BY {a}.file_path, upper({b}.file_path)"""


@query(_links(False))
def file_dependencies(g: Graph) -> DataFrame:
    return files.file_dependencies(g.nodes, g.edges)


@query(_links(True))
def file_dependents(g: Graph) -> DataFrame:
    return files.file_dependencies(g.nodes, g.edges, incoming=True)


@query(f""", u AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges WHERE {USAGE} AND {RESOLVED} AND source_id <> target_id)
SELECT id, CAST(CASE type WHEN 'Class' THEN 5 WHEN 'Interface' THEN 3 WHEN 'Method' THEN 2 ELSE 1 END + (end_line - start_line + 1) // 10 AS BIGINT) AS complexity, CAST(end_line - start_line + 1 AS BIGINT) AS lines,
  CAST(coalesce(a.n, 0) AS BIGINT) AS uses, CAST(coalesce(b.n, 0) AS BIGINT) AS used_by
FROM nodes LEFT JOIN (SELECT s, count(*) AS n FROM u GROUP BY s) a ON a.s = id LEFT JOIN (SELECT t, count(*) AS n FROM u GROUP BY t) b ON b.t = id""")
def metrics(g: Graph) -> DataFrame:
    return stats.metrics(g, g.nodes)


@query("SELECT 0 AS proximity, upper(file_path) AS \"group\", id AS node FROM nodes WHERE file_path <> '' UNION ALL SELECT 1, upper(namespace), id FROM nodes WHERE namespace <> ''")
def related_groups(g: Graph) -> DataFrame:
    return files.related_groups(g.nodes)


@query("SELECT 'node' AS what, type AS kind, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE type <> '' GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE type <> '' GROUP BY type UNION ALL SELECT 'node', '*', count(*) FROM nodes UNION ALL SELECT 'edge', '*', count(*) FROM edges")
def graph_stats(g: Graph) -> DataFrame:
    return stats.graph_stats(g)


_FILES = """(SELECT concat('/wh/users/u', user_id, '.', CASE user_id % 3 WHEN 0 THEN 'cs' WHEN 1 THEN 'ts' ELSE 'md' END) AS file_path, CASE WHEN count(*) % 5 = 0 THEN 'Failed' WHEN count(*) % 5 = 1 THEN 'Pending' ELSE 'Completed' END AS status FROM events GROUP BY user_id)"""


@query(f"SELECT 'status' AS what, s AS value, CAST((SELECT count(*) FROM {_FILES} f WHERE status = s) AS BIGINT) AS n FROM (VALUES ('Pending'), ('Processing'), ('Completed'), ('Failed'), ('Skipped')) v(s) UNION ALL SELECT 'language', CASE WHEN file_path LIKE '%.cs' THEN 'C#' WHEN file_path LIKE '%.ts' THEN 'TypeScript' ELSE '' END, count(*) FROM {_FILES} f GROUP BY 2", graph=False)
def file_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.file_stats(spark.sql(f"SELECT * FROM {_FILES.replace('FROM events', 'FROM {events}')}", events=spark.read.parquet(f"{sf}/events.parquet")))


@query("SELECT id, CASE WHEN starts_with(file_path, '/wh/') THEN substr(file_path, 5) ELSE file_path END AS display_path FROM nodes")
def display_path(g: Graph) -> DataFrame:
    return g.nodes.select("id", X.display_path("file_path", "/wh").alias("display_path"))


@query("SELECT id, CASE WHEN start_line % 2 = 0 AND identifier <> '' THEN identifier ELSE regexp_extract(id, '^[^:]*:[^:]*:(.*)$', 1) END AS identifier FROM nodes")
def legacy_identifier(g: Graph) -> DataFrame:
    return g.nodes.select("id", X.legacy_identifier(F.when(F.col("start_line") % 2 == 0, F.col("identifier")).otherwise("")).alias("identifier"))


@query("SELECT id, greatest(0, start_line - 1) AS start_line, greatest(0, end_line - 1) + 1 AS end_line FROM nodes")
def span_normalize(g: Graph) -> DataFrame:
    return g.nodes.select("id", X.normal_span("start_line", 1).alias("start_line"), X.normal_span("end_line", 1, True).alias("end_line"))


@query("SELECT id, regexp_replace(trim(signature), '\\s+', ' ', 'g') AS signature FROM nodes")
def compact_signature(g: Graph) -> DataFrame:
    return g.nodes.select("id", X.compact_signature().alias("signature"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) d) x WHERE n = 1", graph=False)
def dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keyed = rows.withColumn("id", F.struct("l_orderkey", "l_linenumber")).withColumn("ord", F.struct("l_partkey", "l_suppkey"))
    return commit.dedup_last_wins(keyed, "ord").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT id, file_path, CAST(pos AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_path, pos DESC) AS n FROM (SELECT concat('part/', l_partkey) AS id, concat('/wh/f', l_suppkey % 20, '.cs') AS file_path, l_orderkey AS pos FROM lineitem) f) x WHERE n = 1", graph=False)
def ordinal_min_owner(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    facts = rows.select(F.concat(F.lit("part/"), "l_partkey").alias("id"), F.concat(F.lit("/wh/f"), F.col("l_suppkey") % 20, F.lit(".cs")).alias("file_path"), F.col("l_orderkey").alias("pos"))
    return commit.ordinal_min_owner(facts).select("id", "file_path", F.col("pos").cast("long").alias("pos"))


@query("""SELECT file_path, change FROM (SELECT file_path, CASE WHEN max(mod_ne) THEN 'changed' END AS change FROM (SELECT file_path, start_line % 7 = 0 AND parser_id = 'ship' AS mod_ne FROM nodes WHERE file_path NOT LIKE '%Supplier3%') a GROUP BY file_path
UNION ALL SELECT DISTINCT file_path, 'removed' FROM nodes WHERE file_path LIKE '%Supplier3%') x WHERE change IS NOT NULL""")
def fact_hash_diff(g: Graph) -> DataFrame:
    after = g.nodes.where("file_path not like '%Supplier3%'").withColumn("end_line", F.when((F.col("start_line") % 7 == 0) & (F.col("parser_id") == "ship"), F.col("end_line") + 1).otherwise(F.col("end_line")))
    return commit.fact_hash_diff(g.nodes, after)


_DELTA_NODES = "(SELECT * FROM nodes WHERE parser_id = 'ship' AND (type = 'Class' OR CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 10 <> 0))"


def _delta(g: Graph) -> Graph:
    part = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    n = g.nodes.where("parser_id = 'ship'").where((F.col("type") == "Class") | (part % 10 != 0))
    return Graph(n, g.edges.where("parser_id = 'ship'").join(n.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(g.edges.columns))


_SHARDS = "SELECT 'node' AS what, parser_id, id FROM {nodes} UNION ALL SELECT 'edge', parser_id, id FROM {edges}"


def _shards(g: Graph) -> DataFrame:
    return g.nodes.select(F.lit("node").alias("what"), "parser_id", "id").union(g.edges.select(F.lit("edge"), "parser_id", "id"))


@query(f""", dn AS {_DELTA_NODES}, lost AS (SELECT id FROM nodes WHERE parser_id = 'ship' AND id NOT IN (SELECT id FROM dn)),
nn AS (SELECT parser_id, id FROM nodes WHERE parser_id <> 'ship' UNION ALL SELECT parser_id, id FROM dn),
ne AS (SELECT parser_id, id FROM edges WHERE parser_id = 'ship' AND source_id IN (SELECT id FROM dn)
  UNION ALL SELECT parser_id, id FROM edges WHERE parser_id <> 'ship' AND source_id NOT IN (SELECT id FROM nodes WHERE parser_id = 'ship') AND target_id NOT IN (SELECT id FROM lost))
{_SHARDS.format(nodes='nn', edges='ne')}""", keep=True)
def commit_scoped(g: Graph) -> DataFrame:
    return _shards(commit.commit_scoped(g, _delta(g), "ship", "default"))


@query(f""", r AS (SELECT id FROM nodes WHERE parser_id = 'ship' AND file_path IN ('/wh/part/Brand#1.ts', '/wh/part/Brand#2.ts')),
dn AS (SELECT * FROM nodes WHERE id IN (SELECT id FROM r) AND CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 2 = 0), lost AS (SELECT id FROM r WHERE id NOT IN (SELECT id FROM dn)),
de AS (SELECT * FROM edges WHERE parser_id = 'ship' AND source_id IN (SELECT id FROM dn)),
nn AS (SELECT parser_id, id FROM nodes WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT parser_id, id FROM dn),
ne AS (SELECT parser_id, id FROM edges WHERE source_id NOT IN (SELECT id FROM r) AND target_id NOT IN (SELECT id FROM lost) AND id NOT IN (SELECT id FROM de) UNION ALL SELECT parser_id, id FROM de)
{_SHARDS.format(nodes='nn', edges='ne')}""", keep=True)
def sweep_foreign(g: Graph) -> DataFrame:
    scope = ["/wh/part/Brand#1.ts", "/wh/part/Brand#2.ts"]
    n = g.nodes.where((F.col("parser_id") == "ship") & F.col("file_path").isin(scope) & (F.regexp_extract("id", "([0-9]+)$", 1).cast("long") % 2 == 0))
    e = g.edges.where("parser_id = 'ship'").join(n.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(g.edges.columns)
    return _shards(commit.commit_scoped(g, Graph(n, e), "ship", "default", scope))


@query(_SHARDS.format(nodes=_DELTA_NODES + " d", edges=f"(SELECT * FROM edges WHERE parser_id = 'ship' AND source_id IN (SELECT id FROM {_DELTA_NODES} d)) e"))
def commit_full(g: Graph) -> DataFrame:
    return _shards(commit.commit_full(_delta(g)))


@query(f""", gone AS (SELECT id FROM nodes WHERE file_path IN ('/wh/src/Customer0.cs', '/wh/src/Customer1.cs', '/wh/src/Customer2.cs', '/wh/src/Customer3.cs', '/wh/src/Customer4.cs')),
nn AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)), ne AS (SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)) {_SHARDS.format(nodes='nn', edges='ne')}""", keep=True)
def prune_files(g: Graph) -> DataFrame:
    keep = g.nodes.where("not file_path rlike '^/wh/src/Customer[0-4][.]cs$'").select("file_path").distinct()
    return _shards(commit.prune_files(g, keep))


@query("SELECT 'node' AS kind, id FROM nodes WHERE id NOT LIKE 'ship:default:%' UNION ALL SELECT 'edge', id FROM edges WHERE id NOT LIKE 'ship:default:%' UNION ALL SELECT 'source', source_id FROM edges WHERE source_id NOT LIKE 'ship:default:%'")
def delta_validate(g: Graph) -> DataFrame:
    return commit.delta_validate(g.nodes, g.edges, "ship:default:")


_CHUNKS = "SELECT concat('p', user_id % 5) AS parser_id, 'default' AS workspace_id, CAST(event_id % 4 AS BIGINT) AS generation, CAST(event_id % 4 AS BIGINT) AS request_id, CAST(event_id AS INT) AS chunk_ord, concat('n', event_id) AS node, event_type = 'error' AS is_last_for_request FROM {e}"


@query("WITH c AS (" + _CHUNKS.format(e="events") + "), w AS (SELECT parser_id, max(generation) AS generation FROM c GROUP BY parser_id) SELECT parser_id, CAST(generation AS BIGINT) AS generation, CAST(count(*) AS BIGINT) AS n_nodes, string_agg(node, ',' ORDER BY chunk_ord) AS nodes FROM c JOIN w USING (parser_id, generation) GROUP BY 1, 2 HAVING bool_or(is_last_for_request)", graph=False)
def delta_assemble(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_CHUNKS.format(e="{events}"), events=spark.read.parquet(f"{sf}/events.parquet"))
    chunks = rows.select("*", F.array("node").alias("nodes"), F.array(F.lit("e")).alias("edges"), F.lit(False).alias("replaces_workspace"), F.array("node").alias("replaces_files"))
    out = commit.delta_assemble(chunks)
    return out.select("parser_id", "generation", F.size("nodes").cast("long").alias("n_nodes"), F.array_join("nodes", ",").alias("nodes"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_FILES.replace('FROM events', 'FROM {events}')}", events=spark.read.parquet(f"{sf}/events.parquet"))


@query(f"SELECT file_path FROM {_FILES} f WHERE status <> 'Completed' OR file_path LIKE '%3.%' UNION ALL SELECT '/wh/new.cs'", graph=False)
def needs_processing(spark: SparkSession, sf: str) -> DataFrame:
    meta = _files(spark, sf).withColumn("last_modified", F.lit("2024-01-01").cast("timestamp"))
    later = F.when(F.col("file_path").like("%3.%"), F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("timestamp")
    now = meta.select("file_path", later.alias("modified"))
    now = now.union(now.limit(1).select(F.lit("/wh/new.cs"), "modified"))
    return commit.needs_processing(now, meta).select("file_path")


_CHANGES = "SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, concat('/wh/users/u', user_id, '.cs') AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'changed' END AS change_type FROM {e}"
_GAP, _CAP = 600_000_000, 2_400_000_000
_BATCHES = f"""WITH RECURSIVE c AS ({_CHANGES.format(e='events')}), t AS (SELECT us, row_number() OVER (ORDER BY us) AS n FROM (SELECT DISTINCT epoch_us(ts) AS us FROM c) x),
b AS (SELECT n, us, us AS batch FROM t WHERE n = 1 UNION ALL SELECT t.n, t.us, CASE WHEN t.us - b.us <= {_GAP} AND t.us <= b.batch + {_CAP} THEN b.batch ELSE t.us END FROM b JOIN t ON t.n = b.n + 1)"""


def _batched(spark: SparkSession, sf: str) -> DataFrame:
    return changes.micro_batch(spark.sql(_CHANGES.format(e="{events}"), events=spark.read.parquet(f"{sf}/events.parquet")), _GAP, _CAP)


@query(_BATCHES + " SELECT batch, CAST(count(*) AS BIGINT) AS n FROM c JOIN b ON epoch_us(c.ts) = b.us GROUP BY batch", graph=False)
def micro_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _batched(spark, sf).groupBy("batch").agg(F.count("*").alias("n"))


@query(_BATCHES.replace("WITH RECURSIVE", "WITH RECURSIVE") + """, o AS (SELECT b.batch, c.path, c.change_type AS k, row_number() OVER (PARTITION BY b.batch, c.path ORDER BY c.ts, c.seq) AS n FROM c JOIN b ON epoch_us(c.ts) = b.us),
f AS (SELECT batch, path, n, k FROM o WHERE n = 1 UNION ALL SELECT o.batch, o.path, o.n, CASE WHEN o.k = 'deleted' THEN 'deleted' WHEN f.k = 'deleted' AND o.k = 'created' THEN 'changed' WHEN f.k = 'created' THEN 'created' ELSE o.k END FROM f JOIN o ON o.batch = f.batch AND o.path = f.path AND o.n = f.n + 1)
SELECT batch, path, arg_max(k, n) AS change_type, CAST(max(n) AS BIGINT) AS n FROM f GROUP BY 1, 2""", graph=False)
def coalesce_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.coalesce_changes(_batched(spark, sf))


@query("WITH c AS (" + _CHANGES.format(e="events") + ") SELECT path, CASE WHEN path LIKE '%1.cs' OR path NOT LIKE '%u1%' THEN 'deleted' ELSE change_type END AS change_type FROM c", graph=False)
def effective_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_CHANGES.format(e="{events}"), events=spark.read.parquet(f"{sf}/events.parquet"))
    return changes.effective_changes(rows, rows.where("path like '%u1%'").select("path"), rows.where("path like '%1.cs'").select("path"))


@query("SELECT DISTINCT file_path AS path, NOT (file_path LIKE '%/tests/%' OR (file_path LIKE '%.ts' AND file_path NOT LIKE '%Supplier7.ts')) AS included FROM nodes")
def ignore_filter(g: Graph) -> DataFrame:
    rules = ignore.compile_rules(g.nodes.sparkSession, [("", "tests/\n*.ts\n!Supplier7.ts\n")])
    return ignore.ignore_filter(g.nodes.select(F.expr("substring(file_path, 2)").alias("path")).distinct(), rules).select(F.concat(F.lit("/"), "path").alias("path"), "included")


def _walk(incoming: bool, depth: int) -> str:
    near, far = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    return f""", u AS (SELECT {near} AS a, {far} AS b, [coalesce(id, ''), source_id, target_id, coalesce(type, '')] AS k, coalesce(type, 'USES') AS shown FROM edges WHERE {USAGE} AND {RESOLVED}),
w AS (SELECT id AS root, id AS node, 0 AS distance, CAST([] AS VARCHAR[][]) AS k, CAST([] AS VARCHAR[]) AS p FROM nodes
  UNION ALL SELECT w.root, u.b, w.distance + 1, list_append(w.k, u.k), list_append(w.p, u.shown) FROM w JOIN u ON u.a = w.node WHERE w.distance < {depth}),
f AS (SELECT root, node, min(distance) AS distance FROM w GROUP BY 1, 2),
g AS (SELECT w.root, w.node, w.distance, arg_min(w.p, w.k) AS p FROM w JOIN f ON w.root = f.root AND w.node = f.node AND w.distance = f.distance WHERE w.distance > 0 GROUP BY 1, 2, 3)
SELECT root, node, CAST(distance AS INTEGER) AS distance, array_to_string(p, '>') AS path FROM g"""


def _flat(found: DataFrame) -> DataFrame:
    return found.select("root", "node", "distance", F.array_join("relation_path", ">").alias("path"))


@query(_walk(False, 3), distinct=False)
def traverse_uses(g: Graph) -> DataFrame:
    return _flat(walks.traverse_all(g.nodes, g.edges, 3, False))


@query(_walk(True, 3), distinct=False)
def traverse_used_by(g: Graph) -> DataFrame:
    return _flat(walks.traverse_all(g.nodes, g.edges, 3, True))


@query(_walk(False, 3) + " WHERE distance > 1", distinct=False)
def transitive_uses(g: Graph) -> DataFrame:
    return traverse_uses(g).where("distance > 1")


@query(_walk(True, 3) + " WHERE distance > 1", distinct=False)
def transitive_used_by(g: Graph) -> DataFrame:
    return traverse_used_by(g).where("distance > 1")


_FAMILY = f""", k AS (SELECT source_id AS a, target_id AS b FROM edges WHERE {KIN} AND {RESOLVED} UNION SELECT target_id, source_id FROM edges WHERE {KIN} AND {RESOLVED}),
m AS (SELECT id AS root, id AS node FROM nodes WHERE type = 'Method' UNION SELECT m.root, k.b FROM m JOIN k ON k.a = m.node)"""


@query(_FAMILY + " SELECT root, node FROM m", keep=True)
def method_family(g: Graph) -> DataFrame:
    return traverse.method_family(g.nodes, g.edges, _heads(g))


@query(_FAMILY + f" SELECT DISTINCT root, node FROM m JOIN edges ON target_id = node WHERE {USAGE} AND {RESOLVED}", keep=True)
def statically_bound_targets(g: Graph) -> DataFrame:
    return traverse.statically_bound_targets(g.nodes, g.edges, _heads(g))


@query(_FAMILY + f""", u AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges WHERE {USAGE} AND {RESOLVED}), d1 AS (SELECT DISTINCT m.root, s AS node FROM m JOIN u ON t = node WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.root = m.root AND x.node = s))
SELECT root, node, CAST(1 AS INTEGER) AS distance FROM d1""", keep=True)
def family_used_by(g: Graph) -> DataFrame:
    return traverse.family_reach(g.nodes, g.edges, _heads(g), 1)


@query(keep=True)
def family_used_by_deep(g: Graph) -> DataFrame:
    return _flat(traverse.family_used_by(g.nodes, g.edges, _heads(g), 3))


@query(_FAMILY + f""", l AS (SELECT target_id, arg_min(type, id) AS kind FROM edges WHERE {KIN} GROUP BY 1),
n AS (SELECT root, node, CASE kind WHEN 'IMPLEMENTS_MEMBER' THEN 'interface' WHEN 'OVERRIDES_MEMBER' THEN 'base' ELSE CASE WHEN node = root THEN 'exact' ELSE 'implementation' END END AS label FROM m LEFT JOIN l ON target_id = node),
c AS (SELECT DISTINCT n.root, source_id AS caller, label FROM n JOIN edges ON target_id = node WHERE {USAGE} AND {RESOLVED} AND NOT EXISTS (SELECT 1 FROM m x WHERE x.root = n.root AND x.node = source_id))
SELECT root, caller, string_agg(label, ',' ORDER BY label) AS bindings FROM c GROUP BY 1, 2""", keep=True)
def bindings(g: Graph) -> DataFrame:
    return traverse.bindings(g.nodes, g.edges, _heads(g)).select("root", "caller", F.array_join("bindings", ",").alias("bindings"))


_SHORT = "concat('test', replace(replace(replace(replace(replace(lower(name), 'get', ''), 'set', ''), 'create', ''), 'update', ''), 'delete', ''))"
_TESTED = _FAMILY + f""", fam AS (SELECT root, node FROM m UNION SELECT id, id FROM nodes WHERE type <> 'Method'),
u AS (SELECT source_id AS s, target_id AS t, type FROM edges WHERE {USAGE} AND {RESOLVED}), tests AS (SELECT id, name, signature, type, file_path, {TEST_METHOD} AS is_method FROM nodes WHERE {TEST_PATH}),
w AS (SELECT id AS test, id AS node, 0 AS d FROM tests WHERE is_method UNION SELECT test, u.t, d + 1 FROM w JOIN u ON u.s = node WHERE d < 5), f AS (SELECT test, node, min(d) AS d FROM w WHERE d > 0 AND node <> test GROUP BY 1, 2),
far AS (SELECT fam.root, f.test, min(f.d) AS d FROM f JOIN fam ON fam.node = f.node WHERE NOT EXISTS (SELECT 1 FROM fam x WHERE x.root = fam.root AND x.node = f.test) GROUP BY 1, 2),
g AS (SELECT root, file_path AS file, CASE type WHEN 'IMPLEMENTS' THEN 'testImplementer' ELSE 'testReference' END AS evidence, NULL AS method, s AS source FROM fam JOIN (SELECT u.s, u.t, u.type FROM u) e ON e.t = node JOIN (SELECT id, file_path FROM tests) x ON x.id = s
UNION SELECT root, file_path, CASE WHEN root = node THEN 'directCall' ELSE 'potentialDispatch' END, s, NULL FROM fam JOIN (SELECT s, t FROM u WHERE type IN ('CALLS', 'MOCK_CALLS')) e ON e.t = node JOIN tests ON id = s WHERE is_method
UNION SELECT r.id, x.file_path, 'memberCall', s, NULL FROM nodes r JOIN edges c ON c.source_id = r.id AND upper(c.type) IN ('HAS_METHOD','HAS_PROPERTY','HAS_FIELD','CONTAINS') JOIN (SELECT s, t FROM u WHERE type IN ('CALLS', 'MOCK_CALLS')) e ON e.t = c.target_id JOIN tests x ON x.id = s WHERE x.is_method AND r.type <> 'Method'
UNION SELECT root, file_path, CASE d WHEN 1 THEN 'testReference' ELSE 'indirectReference' END, test, test FROM far JOIN tests ON id = test),
names AS (SELECT DISTINCT lower(name) AS low, {_SHORT} AS short FROM nodes WHERE name <> ''),
tm AS (SELECT id, file_path AS file, lower(name) AS name, lower(signature) AS sig, lower(regexp_extract(file_path, '([^/]*)[.][^./]*$', 1)) AS stem FROM tests WHERE is_method AND type = 'Method'),
hm AS (SELECT low, file, id FROM tm JOIN names ON contains(name, low) OR contains(name, short) OR contains(sig, low) OR contains(stem, low)),
tf AS (SELECT file_path AS file, count(*) AS n, lower(regexp_extract(file_path, '([^/]*)$', 1)) AS base FROM tests GROUP BY 1),
hf AS (SELECT low, file FROM tf JOIN names ON contains(base, low) UNION SELECT low, file FROM hm),
hc AS (SELECT low, file FROM (SELECT low, file, coalesce(sum(n) OVER (PARTITION BY low ORDER BY upper(file) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hf JOIN tf USING (file)) x WHERE before < 10),
h AS (SELECT id AS root, file FROM nodes JOIN hc ON low = lower(name)),
e AS (SELECT * FROM g UNION SELECT root, file, 'namingHeuristic', NULL, NULL FROM h
UNION SELECT n.id, hm.file, 'heuristicMethod', hm.id, NULL FROM nodes n JOIN hm ON low = lower(n.name) WHERE (n.id, hm.file) IN (SELECT root, file FROM g UNION SELECT root, file FROM h) AND (n.id, hm.file, hm.id) NOT IN (SELECT root, file, method FROM g WHERE method IS NOT NULL))"""


_CAP = """hc AS (SELECT low, file FROM (SELECT low, file, coalesce(sum(n) OVER (PARTITION BY low ORDER BY upper(file) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hf JOIN tf USING (file)) x WHERE before < 10),
"""
_WHOLE = _TESTED.replace(_CAP, "").replace("JOIN hc ON", "JOIN hf ON")  # all files that names speak for


@query(_WHOLE + " SELECT root, file, evidence, CAST(count(DISTINCT method) AS BIGINT) AS methods FROM e GROUP BY 1, 2, 3", distinct=False)
def test_evidence_files(g: Graph) -> DataFrame:
    return witness.by_file(g)


@query(_WHOLE + """, s AS (SELECT root, bool_or(evidence IN ('directCall', 'memberCall')) AS directly_tested, count(DISTINCT CASE WHEN evidence IN ('testReference', 'indirectReference') THEN source END) AS refs, count(DISTINCT CASE WHEN evidence = 'testImplementer' THEN source END) AS imps, count(DISTINCT CASE WHEN evidence = 'heuristicMethod' THEN concat(file, ' ', method) END) AS heus, count(DISTINCT file) AS fs FROM e GROUP BY root)
SELECT r.id AS root, coalesce(directly_tested, false) AS directly_tested, CAST(coalesce(refs, 0) AS BIGINT) AS "references", CAST(coalesce(imps, 0) AS BIGINT) AS implementers, CAST(coalesce(heus, 0) AS BIGINT) AS heuristics, CAST(coalesce(fs, 0) AS BIGINT) AS files, coalesce(directly_tested, false) OR coalesce(refs, 0) > 0 OR coalesce(imps, 0) > 0 OR coalesce(heus, 0) > 0 AS is_tested FROM nodes r LEFT JOIN s ON r.id = s.root""", distinct=False)
def test_evidence_summary(g: Graph) -> DataFrame:
    return witness.summary(g)


def _tagged(tag: str, tested: str = _TESTED) -> str:
    return tested + f" SELECT root, file, method FROM e WHERE evidence = '{tag}'"


def _tag(g: Graph, tag: str) -> DataFrame:
    tests = checkpointed(evidence.test_symbols(g.nodes))
    return evidence.graph_evidence(g.nodes, g.edges, g.nodes, tests).where(F.col("evidence") == tag).select("root", "file", "method").distinct()


@query(_tagged("indirectReference"), keep=True)
def indirect_tests(g: Graph) -> DataFrame:
    return _tag(g, "indirectReference")


@query(_tagged("memberCall"), keep=True)
def member_call_tests(g: Graph) -> DataFrame:
    return _tag(g, "memberCall")


@query(_tagged("potentialDispatch"), keep=True)
def potential_dispatch_tests(g: Graph) -> DataFrame:
    return _tag(g, "potentialDispatch")


@query(_tagged("heuristicMethod", _WHOLE), distinct=False)
def heuristic_tests(g: Graph) -> DataFrame:
    return witness.heuristics(g)


@query(_TESTED + """, fl AS (SELECT root, file, string_agg(DISTINCT CASE WHEN evidence <> 'heuristicMethod' THEN evidence END, ',' ORDER BY CASE WHEN evidence <> 'heuristicMethod' THEN evidence END) AS evidence, count(DISTINCT method) AS test_count FROM e GROUP BY 1, 2),
fp AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY upper(file), file) AS file_place, count(*) OVER (PARTITION BY root) AS file_count FROM fl),
mp AS (SELECT root, file, method, row_number() OVER (PARTITION BY root, file ORDER BY start_line, method) AS place FROM (SELECT DISTINCT root, file, method FROM e WHERE method IS NOT NULL) x JOIN (SELECT id, start_line FROM nodes) n ON n.id = method)
SELECT fp.root, fp.file, fp.evidence, mp.method, CAST(mp.place AS INTEGER) AS place, CAST(test_count AS BIGINT) AS test_count, CAST(file_place AS INTEGER) AS file_place, CAST(file_count AS BIGINT) AS file_count FROM fp LEFT JOIN mp ON fp.root = mp.root AND fp.file = mp.file AND place <= 5 WHERE file_place <= 5""", distinct=False)
def test_file_caps(g: Graph) -> DataFrame:
    out = witness.capped(g, evidence.HEURISTIC_NODES)
    return out.withColumn("evidence", F.array_join("evidence", ",")).select("root", "file", "evidence", "method", "place", "test_count", "file_place", "file_count")


_REQUESTS = f"(SELECT 1 AS req, 'ship:part/7' AS query UNION ALL SELECT 2, {NAME} UNION ALL SELECT 3, 'ring' UNION ALL SELECT 4, 'nothing like it' UNION ALL SELECT 5, 'tests/ordertests7.cs' UNION ALL SELECT 6, 'ASIA')"
_FOUND = f""", requests AS {_REQUESTS},
idn AS (SELECT r.req, r.query, n.*, 'identity' AS match_mode FROM requests r JOIN nodes n ON query = identifier),
pth AS (SELECT r.req, r.query, n.*, 'filePath' AS match_mode FROM requests r JOIN nodes n ON upper(file_path) LIKE concat('%/', upper(query)) WHERE contains(query, '/') AND req NOT IN (SELECT req FROM idn)),
ex AS (SELECT r.req, r.query, n.*, 'exact' AS match_mode FROM requests r JOIN nodes n ON upper(query) = upper(name) WHERE NOT contains(query, '/') AND req NOT IN (SELECT req FROM idn)),
sb AS (SELECT r.req, r.query, n.*, 'substring' AS match_mode FROM requests r JOIN nodes n ON contains(upper(name), upper(query)) WHERE NOT contains(query, '/') AND req NOT IN (SELECT req FROM idn UNION SELECT req FROM ex)),
fnd AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY CASE WHEN upper(name) = upper(query) THEN 0 ELSE 1 END, {TEST_PATH}, {TYPE_RANK}, upper(file_path), start_line, identifier, id) AS place, count(*) OVER (PARTITION BY req) AS total
  FROM (SELECT * FROM idn UNION ALL SELECT * FROM pth UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM sb) x),
kinds AS (SELECT req, string_agg(concat(type, ' (', n, ')'), ', ' ORDER BY n DESC, upper(type)) AS types FROM (SELECT req, type, n FROM (SELECT req, type, count(*) AS n, row_number() OVER (PARTITION BY req ORDER BY count(*) DESC, upper(type)) AS p FROM fnd GROUP BY req, type) y WHERE p <= 3) z GROUP BY req),
dis AS (SELECT f.req, CASE WHEN match_mode = 'filePath' THEN 'File contains multiple symbols. Specify ''type'' or a symbol name to expand one.'
  WHEN total <= 5 THEN concat('Multiple matches found. Pass identifier=''', identifier, ''' unchanged, or use containingType, namespace, signature, or sourceFile.')
  ELSE concat(total, ' matches found. Narrow with type (', types, '), containingType, namespace, signature, or sourceFile.', CASE WHEN match_mode = 'substring' THEN ' Or set exact=true to require an exact name.' ELSE '' END) END AS hint FROM fnd f JOIN kinds k ON f.req = k.req WHERE place = 1 AND total > 1),
mis AS (SELECT req, concat('No matches found for identifier ''', query, '''') AS hint FROM requests WHERE req NOT IN (SELECT req FROM fnd)),
tgt AS (SELECT req, CAST(place AS INTEGER) AS place, id, name, type, CASE WHEN starts_with(file_path, '/wh/') THEN substr(file_path, 5) ELSE file_path END AS file, start_line + 1 AS line, regexp_replace(trim(signature), '\\s+', ' ', 'g') AS signature, identifier FROM fnd WHERE place <= 5),
ans AS (SELECT r.req, coalesce(min(match_mode), 'substring') AS match_mode, coalesce(min(match_mode), '') = 'exact' AS substring_skipped, CAST(count(f.id) AS BIGINT) AS total, count(f.id) > 1 AS ambiguous, CAST(least(count(f.id), 5) AS BIGINT) AS returned, count(f.id) > 5 AS truncated, min(h.hint) AS hint
  FROM requests r LEFT JOIN fnd f ON r.req = f.req LEFT JOIN (SELECT * FROM dis UNION ALL SELECT * FROM mis) h ON r.req = h.req GROUP BY r.req)"""


def _asked(g: Graph) -> DataFrame:
    rows = [(1, "ship:part/7"), (2, _first_part(g)), (3, "ring"), (4, "nothing like it"), (5, "tests/ordertests7.cs"), (6, "ASIA")]
    return g.nodes.sparkSession.createDataFrame(rows, "req int, query string")


def _candidates(g: Graph, **filters: str) -> DataFrame:
    return context.ranked(resolve.find_candidates(g.nodes, _asked(g), **filters))


@query(_FOUND + " SELECT req, id, match_mode, CAST(place AS INTEGER) AS place, CAST(total AS BIGINT) AS total FROM fnd", keep=True)
def find_candidates(g: Graph) -> DataFrame:
    return _candidates(g).select("req", "id", "match_mode", "place", "total")


@query(_FOUND + " SELECT * FROM ans", keep=True)
def multi_context(g: Graph) -> DataFrame:
    return context.compact_context(g, _asked(g), context.Options(root_path="/wh")).answers


@query(_FOUND + " SELECT * FROM tgt", keep=True)
def compact_context(g: Graph) -> DataFrame:
    return context.compact_context(g, _asked(g), context.Options(root_path="/wh")).targets


@query(_FOUND + " SELECT * FROM dis", keep=True)
def disambiguation_hint(g: Graph) -> DataFrame:
    return context.disambiguation_hint(_candidates(g))


@query(_FOUND + """, fc AS (SELECT req FROM fnd WHERE type = 'Interface'), k5 AS (SELECT req, string_agg(concat(type, ' (', n, ')'), ', ' ORDER BY n DESC, upper(type)) AS types, sum(n) AS n FROM (SELECT req, type, count(*) AS n FROM fnd GROUP BY 1, 2) y GROUP BY req)
SELECT r.req, CASE WHEN k5.n IS NULL THEN concat('No matches found for identifier ''', query, ''' — the identifier has no matches even without the applied filters.')
  ELSE concat('No matches for ''', query, ''' with the applied filters (type=Interface). ', k5.n, ' match(es) exist without filters — types: ', types, '. Adjust or drop the filters.') END AS hint FROM requests r LEFT JOIN k5 ON r.req = k5.req WHERE r.req NOT IN (SELECT req FROM fc)""", keep=True)
def no_match_hint(g: Graph) -> DataFrame:
    found = _candidates(g, kind="Interface")
    return context.no_match_hint(_asked(g), found, g.nodes, context.Options(kind="Interface"))


@query(_FOUND + """ SELECT a.req, concat('{"match_mode":"', match_mode, '"', CASE WHEN substring_skipped THEN ',"substring_skipped":true' ELSE '' END, ',"total":', total, CASE WHEN ambiguous THEN ',"ambiguous":true' ELSE '' END, ',"returned":', returned, CASE WHEN truncated THEN ',"truncated":true' ELSE '' END,
  coalesce(',"hint":"' || hint || '"', ''), coalesce(',"targets":[' || t.j || ']', ''), '}') AS json FROM ans a LEFT JOIN (SELECT req, string_agg(concat('{"name":"', name, '","type":"', type, '","file":"', file, '","line":', line, ',"signature":"', signature, '","identifier":"', identifier, '"}'), ',' ORDER BY place) AS j FROM tgt GROUP BY req) t ON a.req = t.req""", keep=True)
def response_json(g: Graph) -> DataFrame:
    return context.as_json(context.compact_context(g, _asked(g), context.Options(root_path="/wh")))


_NEAR = f"""u AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges WHERE {USAGE} AND {RESOLVED}), fam AS (SELECT root, node FROM m UNION SELECT id, id FROM nodes WHERE type <> 'Method'),
wo AS (SELECT id AS root, id AS node, 0 AS d FROM nodes UNION SELECT root, t, d + 1 FROM wo JOIN u ON s = node WHERE d < 2), fo AS (SELECT root, node, min(d) AS d FROM wo GROUP BY 1, 2),
wi AS (SELECT root, node, 0 AS d FROM fam UNION SELECT root, s, d + 1 FROM wi JOIN u ON t = node WHERE d < 2), fi AS (SELECT root, node, min(d) AS d FROM wi GROUP BY 1, 2),
dep AS ({_links(False)}), dnt AS ({_links(True)})"""


@query(_FAMILY + f""", {_NEAR} SELECT root, CASE d WHEN 1 THEN 'uses' ELSE 'transitiveUses' END AS section, node, CAST(d AS INTEGER) AS distance FROM fo WHERE d > 0
UNION ALL SELECT root, CASE d WHEN 1 THEN 'usedBy' ELSE 'transitiveUsedBy' END, node, CAST(d AS INTEGER) FROM fi WHERE d > 0
UNION ALL SELECT id, 'fileDependencies', other, 1 FROM nodes JOIN dep ON file_path = file UNION ALL SELECT id, 'fileDependents', other, 1 FROM nodes JOIN dnt ON file_path = file""", distinct=False)
def build_relationships(g: Graph) -> DataFrame:
    return relations.of_all(g, 2)


_SECTIONS = f""", dep AS ({_links(False)}), dnt AS ({_links(True)}), rt AS (SELECT req, id AS root, place AS target, file_path FROM fnd WHERE total = 1),
en AS (SELECT root, 'uses' AS section, target_id AS node, type, line FROM rt JOIN edges ON source_id = root WHERE {USAGE} AND {RESOLVED} AND source_id <> target_id UNION ALL SELECT root, 'usedBy', source_id, type, line FROM rt JOIN edges ON target_id = root WHERE {USAGE} AND {RESOLVED} AND source_id <> target_id),
oc AS (SELECT root, section, node, count(*) AS occurrences, min({REL_RANK}) AS r FROM en GROUP BY 1, 2, 3),
sec AS (SELECT root, section, node, occurrences, r FROM oc UNION ALL SELECT root, 'fileDependencies', other, NULL, NULL FROM rt JOIN dep ON file_path = file UNION ALL SELECT root, 'fileDependents', other, NULL, NULL FROM rt JOIN dnt ON file_path = file),
sp AS (SELECT sec.*, row_number() OVER (PARTITION BY root, section ORDER BY coalesce(r, 0), coalesce({TEST_PATH}, false), {TYPE_RANK}, upper(file_path), start_line, upper(coalesce(identifier, node)), node) AS place, count(*) OVER (PARTITION BY root, section) AS total FROM sec LEFT JOIN nodes ON nodes.id = node)"""


@query(_FOUND + _SECTIONS.replace("upper(type) WHEN 'CLASS'", "upper(nodes.type) WHEN 'CLASS'") + " SELECT rt.req, rt.root, section, CAST(sp.place AS INTEGER) AS place, CAST(sp.total AS BIGINT) AS total, sp.total > 10 AS truncated, node, CAST(occurrences AS BIGINT) AS occurrences FROM sp JOIN rt ON sp.root = rt.root WHERE sp.place <= 10", keep=True)
def compact_relationships(g: Graph) -> DataFrame:
    out = context.compact_context(g, _asked(g), context.Options(root_path="/wh")).relationships
    return out.select("req", "root", "section", "place", "total", "truncated", "node", "occurrences")


@query(keep=True)
def full_context(g: Graph) -> DataFrame:
    out = context.full_context(g, _asked(g), context.Options(depth=2, full=True))
    return out.relationships.select("req", "root", "section", "node", "distance")


@query(keep=True)
def agent_lines(g: Graph) -> DataFrame:
    found = context.compact_context(g, _asked(g), context.Options(root_path="/wh"))
    return context.agent_lines(found, _asked(g)).withColumn("ord", F.array_join(F.col("ord").cast("array<string>"), "."))


@query("SELECT id, identifier, name, parser_id FROM nodes")
def all_nodes(g: Graph) -> DataFrame:
    return g.nodes.select("id", "identifier", "name", "parser_id")


@query("SELECT id, source_id, target_id, type, parser_id FROM edges")
def all_edges(g: Graph) -> DataFrame:
    return g.edges.select("id", "source_id", "target_id", "type", "parser_id")


def _keys(g: Graph) -> DataFrame:
    """Identifiers of parts, and ids of methods, that edges or lines name: a request table of any size."""
    parts = g.edges.where("target_id like 'ship:default:part/%'").select(F.replace("target_id", F.lit("ship:default:"), F.lit("ship:")).alias("key"))
    return parts.union(g.edges.where("target_id like 'tpch:default:orders/%'").select("target_id")).distinct()


_KEYED = "keys AS (SELECT DISTINCT replace(target_id, 'ship:default:', 'ship:') AS key FROM edges WHERE target_id LIKE 'ship:default:part/%' UNION SELECT DISTINCT target_id FROM edges WHERE target_id LIKE 'tpch:default:orders/%')"


@query(f", {_KEYED} SELECT key, id FROM keys JOIN nodes ON key = id UNION SELECT key, id FROM keys JOIN nodes ON key = identifier")
def lookup_nodes(g: Graph) -> DataFrame:
    return resolve.lookup(g.nodes, _keys(g)).select("key", "id")


@query(f", {_KEYED} SELECT key, id, target_id, type FROM keys JOIN edges ON key = source_id")
def edges_of_sources(g: Graph) -> DataFrame:
    return resolve.edges_of(g.edges, _keys(g), "source_id").select("key", "id", "target_id", "type")


@query(f", {_KEYED} SELECT key, id, source_id FROM keys JOIN edges ON key = target_id WHERE type = 'CALLS'")
def edges_of_targets(g: Graph) -> DataFrame:
    return resolve.edges_of(g.edges, _keys(g), "target_id", "CALLS").select("key", "id", "source_id")


@query("SELECT DISTINCT regexp_extract(a.file_path, '([^/]*/[^/]*)$', 1) AS query, n.id FROM nodes a JOIN nodes n ON upper(n.file_path) LIKE concat('%/', upper(regexp_extract(a.file_path, '([^/]*/[^/]*)$', 1)))")
def nodes_by_paths(g: Graph) -> DataFrame:
    asked = g.nodes.select(F.regexp_extract("file_path", "([^/]*/[^/]*)$", 1).alias("query")).distinct().withColumn("req", F.col("query"))
    return resolve.match_paths(g.nodes, asked).select("query", "id")


@query("SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM nodes a JOIN nodes b ON a.file_path = b.file_path")
def same_file(g: Graph) -> DataFrame:
    paths = g.nodes.select(F.col("file_path").alias("a")).distinct()
    met = resolve.match_paths(g.nodes, paths.select(F.col("a").alias("query"), F.col("a").alias("req"))).select(F.col("query").alias("a"), F.col("file_path").alias("b")).distinct()
    return met.where(facts.same_file("a", "b"))


_CLAIMS = "(VALUES ('cs', 'csharp', 0), ('ts', 'typescript', 1), ('cs', 'other', 2), ('md', 'notes', 3)) v(extension, parser_id, claim)"


def _claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("cs", "csharp", 0), ("ts", "typescript", 1), ("cs", "other", 2), ("md", "notes", 3)], "extension string, parser_id string, claim int")


@query(f"SELECT file_path, CASE WHEN file_path LIKE '%.cs' THEN 'csharp' WHEN file_path LIKE '%.ts' THEN 'typescript' WHEN file_path LIKE '%.md' THEN 'notes' END AS parser_id FROM {_FILES} f", graph=False)
def extension_owner(spark: SparkSession, sf: str) -> DataFrame:
    return facts.owner_of(_files(spark, sf).select("file_path"), _claims(spark), "file_path")


@query("SELECT DISTINCT file_path AS path, CASE WHEN file_path LIKE '/wh/src/%' THEN '/wh/src' WHEN file_path LIKE '/wh/part/%' THEN '/wh/part/' ELSE '/wh' END AS root FROM nodes")
def nearest_ancestor(g: Graph) -> DataFrame:
    roots = g.nodes.sparkSession.createDataFrame([("/wh",), ("/wh/src",), ("/wh/part/",), ("/other",)], "root string")
    return facts.nearest_ancestor(g.nodes.select(F.col("file_path").alias("path")).distinct(), roots)


@query("SELECT id, name, type, CASE WHEN starts_with(file_path, '/wh/') THEN substr(file_path, 5) ELSE file_path END AS file, start_line + 1 AS line, regexp_replace(trim(signature), '\\s+', ' ', 'g') AS signature, identifier FROM nodes")
def compact_nodes(g: Graph) -> DataFrame:
    return g.nodes.select("id", *context.compact_node("/wh"))


@query("SELECT id, contains(name, '/') OR contains(name, '\\') OR regexp_matches(name, '[.](cs|ts|tsx|js|jsx|mts|cts|mjs|cjs|vue|py|pyw)$') AS is_name, true AS is_path FROM nodes")
def is_file_path(g: Graph) -> DataFrame:
    return g.nodes.select("id", resolve.is_file_path(F.col("name")).alias("is_name"), resolve.is_file_path(F.col("file_path")).alias("is_path"))


@query("SELECT id, greatest(0, start_line - 1) AS start_line, greatest(0, start_col - 1) AS start_col FROM nodes WHERE type = 'Method' UNION ALL SELECT id, CAST(greatest(0, line - 1) AS INTEGER), CAST(greatest(0, col - 1) AS INTEGER) FROM edges WHERE line IS NOT NULL")
def span_columns(g: Graph) -> DataFrame:
    nodes = g.nodes.where("type = 'Method'").select("id", X.normal_span("start_line", 1).alias("start_line"), X.normal_span("start_col", 1).alias("start_col"))
    return nodes.union(g.edges.where("line is not null").select("id", X.normal_span("line", 1).cast("int"), X.normal_span("col", 1).cast("int")))


@query("SELECT id, concat('isTest=', is_test, ',line=', start_line, ',parser_id=', parser_id, ',workspace_id=', workspace_id) AS metadata FROM nodes")
def stamp_ownership(g: Graph) -> DataFrame:
    own = F.create_map(F.lit("isTest"), "is_test", F.lit("parser_id"), F.lit("forged"), F.lit("line"), F.col("start_line").cast("string"))
    entries = F.transform(F.array_sort(F.map_entries(facts.stamp_ownership(own, "parser_id", "workspace_id"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return g.nodes.select("id", F.array_join(entries, ",").alias("metadata"))


@query("SELECT id, url_encode(concat(name, ' /', namespace)) AS uri FROM nodes")
def workspace_uri(g: Graph) -> DataFrame:
    return g.nodes.select("id", facts.workspace_uri(F.concat("name", F.lit(" /"), "namespace")).alias("uri"))


@query(""", x AS (SELECT 0 AS proximity, upper(file_path) AS "group", * FROM nodes UNION ALL SELECT 1, upper(namespace), * FROM nodes WHERE namespace <> '')
SELECT proximity, "group", id AS node, CAST(row_number() OVER (PARTITION BY proximity, "group" ORDER BY upper(type), upper(file_path), start_line, start_col, upper(name), id) AS INTEGER) AS place FROM x""")
def related_order(g: Graph) -> DataFrame:
    return files.related_order(g.nodes)


@query(_FAMILY + f""", {_NEAR.split(', dep AS')[0]} SELECT root, node, CAST(d AS INTEGER) AS distance, CAST(row_number() OVER (PARTITION BY root ORDER BY d, identifier, node) AS INTEGER) AS place FROM fi JOIN nodes ON nodes.id = node WHERE d > 0 AND root IN (SELECT id FROM nodes WHERE type = 'Method')""", keep=True)
def inbound_order(g: Graph) -> DataFrame:
    return traverse.in_order(traverse.family_reach(g.nodes, g.edges, _heads(g), 2), g.nodes).select("root", "node", "distance", "place")


@query(_FOUND + _SECTIONS + " SELECT req, x.section, CAST(count(CASE WHEN upper(coalesce(type, 'USES')) = 'INHERITS' THEN 1 END) AS BIGINT) AS edges FROM rt JOIN en x ON rt.root = x.root GROUP BY 1, 2", keep=True)
def section_presence(g: Graph) -> DataFrame:
    """A filter that leaves nothing of a section keeps the section, with a total of 0."""
    out = context.compact_context(g, _asked(g), context.Options(root_path="/wh", relation="INHERITS")).relationships
    out = out.where("section in ('uses', 'usedBy')")
    return out.groupBy("req", "section").agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("edges"))


@query("SELECT event_type AS endpoint, CAST(count(*) AS BIGINT) AS calls, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS total, floor(avg(CAST(value * 100 AS BIGINT))) AS mean FROM events GROUP BY 1", graph=False)
def api_metrics(spark: SparkSession, sf: str) -> DataFrame:
    calls = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("endpoint"), F.round(F.col("value") * 100).cast("bigint").alias("latency"))
    return lifecycle.api_metrics(calls).withColumn("mean", F.floor("mean").cast("double"))


@query(f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM nodes) AS nodes, (SELECT CAST(count(*) AS BIGINT) FROM edges) AS edges, (SELECT CAST(count(*) AS BIGINT) FROM nodes WHERE type = 'Method') AS methods, 'Ready' AS state, CAST(1 AS BIGINT) AS operation")
def status(g: Graph) -> DataFrame:
    state = lifecycle.ScanState()
    state.begin()
    state.complete()
    return stats.status(g, state).select("nodes", "edges", F.coalesce(F.col("node_kinds")["Method"], F.lit(0)).alias("methods"), "state", "operation")


@query("SELECT (SELECT CAST(count(*) AS BIGINT) FROM nation) + (SELECT count(*) FROM region) AS nodes_merged, (SELECT CAST(count(*) AS BIGINT) FROM nation) AS edges_merged, (SELECT CAST(count(*) AS BIGINT) FROM nodes) AS nodes_deleted, 'reconcile' AS operation")
def json_reconcile(g: Graph) -> DataFrame:
    fact = lambda df, shape: df.select(F.struct(*[F.col(x.split(":")[0]) for x in shape[7:-1].split(",")]).alias("x")).agg(F.collect_list("x").alias("x")).select(F.to_json("x").alias("j"))
    small = g.nodes.where("type in ('Namespace', 'Interface')")
    n = fact(small, facts.NODE).select(F.lit(1).alias("k"), "j").join(fact(g.edges.where("type = 'INHERITS'"), facts.EDGE).select(F.lit(1).alias("k"), F.col("j").alias("e")), "k")
    return facts.json_reconcile(n.select(F.concat(F.lit('{"nodes":'), "j", F.lit(',"edges":'), "e", F.lit("}")).alias("json")), g)[2]


@query(""", x AS (SELECT 0 AS k, parser_id, id FROM nodes UNION ALL SELECT 1, parser_id, id FROM edges), y AS (SELECT k, parser_id, id, (row_number() OVER (PARTITION BY k, parser_id ORDER BY id) - 1) // 2000 AS c FROM x), z AS (SELECT parser_id, max(c) + 1 AS nc FROM y WHERE k = 0 GROUP BY 1)
SELECT y.parser_id, CAST(CASE k WHEN 0 THEN c ELSE c + nc END AS INTEGER) AS chunk_ord, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id FROM y JOIN z ON y.parser_id = z.parser_id GROUP BY 1, 2""", distinct=False)
def delta_source(g: Graph) -> DataFrame:
    """A shard's facts as chunks in JSON lines, and read again."""
    from weftgraph.plans.staging import shared_dir

    path = f"{shared_dir(g.nodes)}/deltas-{uuid.uuid4().hex}"
    facts.write_deltas(facts.delta_chunks(g, 1, 1), path)
    read = facts.read_deltas(g.nodes.sparkSession, path)
    ids = F.concat(F.transform("nodes", lambda x: x["id"]), F.transform("edges", lambda x: x["id"]))
    return read.select("parser_id", "chunk_ord", F.size(ids).cast("long").alias("n"), F.array_min(ids).alias("first_id"))


_SCAN = f"""f AS (SELECT file_path, status, CASE WHEN file_path LIKE '%.cs' THEN 'csharp' WHEN file_path LIKE '%.ts' THEN 'typescript' ELSE 'notes' END AS parser_id FROM {_FILES} x)"""


@query(f"WITH {_SCAN} SELECT file_path, parser_id FROM f WHERE file_path NOT LIKE '%7.%' AND parser_id IN (SELECT parser_id FROM f WHERE status <> 'Completed' AND file_path NOT LIKE '%7.%') UNION ALL SELECT file_path, 'pruned' FROM f WHERE file_path LIKE '%7.%'", graph=False)
def resumable_scan(spark: SparkSession, sf: str) -> DataFrame:
    meta = _files(spark, sf).withColumn("last_modified", F.lit("2024-01-01").cast("timestamp"))
    here = meta.where("file_path not like '%7.%'").select("file_path", F.lit("2024-01-01").cast("timestamp").alias("modified"))
    scan, gone = facts.files_to_scan(here, meta, _claims(spark))
    return scan.union(gone.select("file_path", F.lit("pruned")))


@query(f"SELECT file_path, CASE status WHEN 'Failed' THEN 'Failed' ELSE 'Pending' END AS status FROM {_FILES} f", graph=False)
def scan_rollback(spark: SparkSession, sf: str) -> DataFrame:
    return facts.rolled_back(_files(spark, sf)).select("file_path", "status")


@query("SELECT CAST(event_id AS BIGINT) AS seq, path, change_type FROM (SELECT event_id, concat('/wh/users/u', user_id, CASE WHEN event_id % 3 = 0 THEN '.cs' ELSE '.bin' END) AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'changed' WHEN 'error' THEN 'deleted' ELSE 'changed' END AS change_type FROM events UNION ALL SELECT event_id, concat('/wh/old/u', user_id, '.cs'), 'deleted' FROM events WHERE event_type = 'purchase') x WHERE path LIKE '%.cs' AND path NOT LIKE '%/u1%'", graph=False)
def change_source(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "renamed").when(F.col("event_type") == "error", "deleted").otherwise("changed")
    name = F.col("user_id").cast("string")
    raw = e.select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("/wh/users/u"), name, F.when(F.col("event_id") % 3 == 0, ".cs").otherwise(".bin")).alias("path"), F.concat(F.lit("/wh/old/u"), name, F.lit(".cs")).alias("old_path"), kind.alias("change_type"))
    rules = ignore.compile_rules(spark, [("", "u1*\n")])
    out = changes.filtered(changes.change_source(raw), rules, _claims(spark), "/wh")
    return out.select("seq", "path", "change_type")


@query(_BATCHES + " SELECT batch, CASE WHEN bool_or(path LIKE '%/u1.cs') THEN 'rescan' ELSE 'apply' END AS action, CAST(count(*) AS BIGINT) AS n FROM c JOIN b ON epoch_us(c.ts) = b.us GROUP BY batch", graph=False)
def control_events(spark: SparkSession, sf: str) -> DataFrame:
    return changes.control(_batched(spark, sf), "u1.cs")


@query("SELECT p.doc_id AS id, array_to_string(list_slice(string_split(p.text, chr(10)), 2, 4), chr(10)) AS content FROM documents p WHERE p.text IS NOT NULL", graph=False)
def content_snippet(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    spans = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("/d/"), "doc_id").alias("file_path"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return files.content_snippet(spans, d.select(F.concat(F.lit("/d/"), "doc_id").alias("file_path"), "text"))


@query(", gone AS (SELECT id FROM nodes WHERE parser_id = 'ship' AND type = 'Class') SELECT 'node' AS what, id FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', id FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'new', concat(id, '!') FROM nodes WHERE type = 'Interface'", keep=True)
def upsert_delete(g: Graph) -> DataFrame:
    gone = g.nodes.where("parser_id = 'ship' and type = 'Class'").select("id")
    after = commit.delete_edges_of(commit.delete_nodes(g, gone), gone)
    again = commit.upsert(after, g.nodes.where("type = 'Interface'").withColumn("name", F.concat("id", F.lit("!"))))
    renamed = again.nodes.where("type = 'Interface'").select(F.lit("new"), "name")
    return again.nodes.select(F.lit("node").alias("what"), "id").union(again.edges.select(F.lit("edge"), "id")).union(renamed)


@query("SELECT file_path, count(*) AS n FROM nodes WHERE parser_id = 'ship' AND file_path NOT LIKE '%Supplier3%' AND file_path IN (SELECT file_path FROM nodes WHERE parser_id = 'ship' AND start_line % 7 = 0) GROUP BY 1 UNION ALL SELECT DISTINCT file_path, 0 FROM nodes WHERE file_path LIKE '%Supplier3%'", keep=True)
def incremental_emission(g: Graph) -> DataFrame:
    own = g.nodes.where("parser_id = 'ship'")
    after = own.where("file_path not like '%Supplier3%'").withColumn("end_line", F.when(F.col("start_line") % 7 == 0, F.col("end_line") + 1).otherwise(F.col("end_line")))
    emitted, replaced = commit.incremental_emission(own, after)
    n = emitted.groupBy("file_path").agg(F.count("*").alias("n"))
    return replaced.join(n, "file_path", "left").select("file_path", F.coalesce("n", F.lit(0)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
