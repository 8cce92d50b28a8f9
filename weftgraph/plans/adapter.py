"""A property graph out of the star schema: two shards, `tpch` and `ship`, with every kind of edge that queries tell apart.

The same text runs on Spark and DuckDB, so it also opens the oracles. No two columns of a branch are one attribute (hence
the ``+ 0``): where such a union joins itself, Catalyst's RemoveRedundantAliases makes an invalid plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NODES_SQL = """
SELECT concat('tpch:default:region/', r_regionkey) AS id, concat('tpch:region/', r_regionkey) AS identifier,
       r_name AS name, 'Namespace' AS type, concat('/wh/region/', r_name, '.cs') AS file_path,
       0 AS start_line, 9 AS end_line, 0 AS start_col, r_name AS namespace, r_name AS signature,
       'false' AS is_test, 'tpch' AS parser_id, 'default' AS workspace_id FROM region
UNION ALL
SELECT concat('tpch:default:nation/', n_nationkey), concat('tpch:nation/', n_nationkey), n_name, 'Interface',
       concat('/wh/nation/', n_name, '.cs'), 0, 19, 0, r_name, n_name, 'false', 'tpch', 'default'
  FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('tpch:default:customer/', c_custkey), concat('tpch:customer/', c_custkey), c_name, 'Class',
       concat('/wh/src/Customer', c_custkey % 50, '.cs'), CAST(c_custkey % 1000 AS INT),
       CAST(c_custkey % 1000 + c_nationkey AS INT), 0, c_mktsegment, concat('class ', c_name), 'false', 'tpch', 'default'
  FROM customer
UNION ALL
SELECT concat('tpch:default:orders/', o_orderkey), concat('tpch:orders/', o_orderkey),
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN concat('Test_order_', o_orderkey)
            ELSE concat('Order_', o_orderkey) END, 'Method',
       CASE WHEN o_orderpriority = '1-URGENT' THEN concat('/wh/tests/OrderTests', o_custkey % 50, '.cs')
            ELSE concat('/wh/src/Order', o_custkey % 50, '.cs') END,
       CAST(o_orderkey % 1000 AS INT), CAST(o_orderkey % 1000 + 12 AS INT), 4, o_orderstatus,
       concat('Order_', o_orderkey, '( int   qty )'),
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END, 'tpch', 'default'
  FROM orders
UNION ALL
SELECT concat('ship:default:part/', p_partkey), concat('ship:part/', p_partkey), p_name, 'Property',
       concat('/wh/part/', p_brand, '.ts'), CAST(p_size AS INT), CAST(p_size AS INT) + 0, 2, p_type, p_name, 'false', 'ship', 'default' FROM part
UNION ALL
SELECT concat('ship:default:supplier/', s_suppkey), concat('ship:supplier/', s_suppkey), s_name, 'Class',
       concat('/wh/supplier/Supplier', s_suppkey % 10, '.ts'), 0, 30, 0, concat('nation', s_nationkey), s_name,
       'false', 'ship', 'default' FROM supplier
"""

EDGES_SQL = """
SELECT DISTINCT concat(source_id, '=[', coalesce(type, 'USES'), ']=>', target_id,
                       CASE WHEN line IS NULL THEN '' ELSE concat('@', line, ':', col) END) AS id,
       source_id, target_id, type, line, col, parser_id, 'default' AS workspace_id
FROM (
  SELECT concat('tpch:default:nation/', n_nationkey) AS source_id, concat('tpch:default:region/', n_regionkey) AS target_id,
         'INHERITS' AS type, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS col, 'tpch' AS parser_id FROM nation
  UNION ALL SELECT concat('tpch:default:customer/', c_custkey), concat('tpch:default:nation/', c_nationkey),
         'IMPLEMENTS', NULL, NULL, 'tpch' FROM customer
  UNION ALL SELECT concat('ship:default:supplier/', s_suppkey), concat('tpch:default:nation/', s_nationkey),
         'IMPLEMENTS', NULL, NULL, 'ship' FROM supplier
  UNION ALL SELECT concat('tpch:default:customer/', o_custkey), concat('tpch:default:orders/', o_orderkey),
         'HAS_METHOD', NULL, NULL, 'tpch' FROM orders
  UNION ALL SELECT concat('tpch:default:orders/', l_orderkey), concat('ship:default:part/', l_partkey),
         CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'R' THEN 'MOCK_CALLS' ELSE 'REFERENCES' END,
         CAST(l_linenumber AS BIGINT), CAST(l_suppkey AS BIGINT), 'tpch' FROM lineitem
  UNION ALL SELECT concat('tpch:default:orders/', l_orderkey), concat('ship:default:supplier/', l_suppkey),
         'IMPORTS', NULL, NULL, 'tpch' FROM lineitem
  UNION ALL SELECT concat('ship:default:part/', l_partkey), concat('ship:default:supplier/', l_suppkey),
         CAST(NULL AS STRING), NULL, NULL, 'ship' FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1
  UNION ALL SELECT concat('tpch:default:orders/', o_orderkey), concat('tpch:default:orders/', first_key),
         CASE o_orderstatus WHEN 'O' THEN 'IMPLEMENTS_MEMBER' ELSE 'OVERRIDES_MEMBER' END, NULL, NULL, 'tpch'
    FROM (SELECT o_orderkey, o_orderstatus, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_key FROM orders) f
    WHERE o_orderkey <> first_key AND o_orderstatus <> 'F'
  UNION ALL SELECT concat('tpch:default:orders/', o_orderkey), concat('tpch:default:orders/', o_orderkey % 997 + 1),
         CASE WHEN o_orderkey % 2 = 0 THEN 'CALLS' ELSE 'REFERENCES' END, CAST(o_custkey AS BIGINT), 1, 'tpch'
    FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey > 997
  UNION ALL SELECT concat('tpch:default:orders/', o_orderkey), concat('tpch:default:nation/', o_custkey % 25),
         'IMPLEMENTS', NULL, NULL, 'tpch' FROM orders WHERE o_orderkey % 53 = 0
  UNION ALL SELECT concat('tpch:default:orders/', o_orderkey), 'external.Unresolved', 'CALLS', 0, 0, 'tpch'
    FROM orders WHERE o_orderkey % 97 = 0
) raw
"""


@dataclass(frozen=True)
class Graph:
    """One version of the graph; a query reads one and passes it down."""

    nodes: DataFrame
    edges: DataFrame
    version: int = 0


def star_graph(spark: SparkSession, sf_dir: str, distinct: bool = True) -> Graph:
    """Without distinct, equal edges stay: for operators that count them once by themselves, with no shuffle for it."""
    names = ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}

    def run(sql: str) -> DataFrame:
        for t in names:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        return spark.sql(sql, **{t: d for t, d in tables.items() if f"{{{t}}}" in sql})

    return Graph(run(NODES_SQL), run(EDGES_SQL if distinct else EDGES_SQL.replace("SELECT DISTINCT", "SELECT", 1)))
