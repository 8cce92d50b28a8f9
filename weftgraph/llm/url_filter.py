"""URL filter lists, matched as hashed expressions.

Each URL is expanded into its host suffixes times its path prefixes, of the sizes that rules have only: a rule's shape
is (labels of its host, characters of its path), and a URL has one expression of each shape at most. Expressions and
rules are equi-joined on the first 32 bits of SHA-256, full digests confirm, and the most specific rule wins: the
longest rule text, then the longest host, then block before allow. Only DataFrame functions run.

Rules of few shapes (``most_shapes``) take one broadcast equi-join per shape: a row meets at most one entry of each, so
records are neither multiplied nor shuffled. Rules of more shapes take one join of exploded expressions; only row
numbers and ranks of confirmed hits are folded, and joined back to the records. The rule side is broadcast when it is
counted to have at most ``broadcast_rules`` rules; beyond that the second way is taken and its join shuffles.

Cases: null URL or one without ``://``: host and path empty, no rule, the default verdict. Very long hosts and paths
cost time in proportion to their length. Empty table: no rows. Repeated rows stay. Other columns are carried along,
whatever their names. An empty rule list gives the default verdict everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import ascii_lower, free_name, quoted, stage, table

#: (verdict, host, path), the lists of the production query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
BROADCAST_RULES, MOST_SHAPES = 50_000, 16


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def names(pages: DataFrame) -> tuple[str, str, str, str]:
    """What judge() calls its columns on this table."""
    return tuple(free_name(pages, n) for n in ("_host", "_path", "_rule", "_verdict"))


def _expression(labels: int, length: int) -> Column:
    """The URL's expression of a shape, null where it has none."""
    suffix = F.substring_index("host", ".", -labels)
    return F.when(F.char_length("path") >= length, F.concat(suffix, F.substring("path", 1, length)))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _confirmed(entries: str, digest: str) -> Column:
    """The rank of the entry whose full digest is the expression's, null without one."""
    return F.get(F.filter(entries, lambda r: r["digest"] == F.col(digest)), F.lit(0))["rank"]


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, broadcast_rules: int = BROADCAST_RULES, most_shapes: int = MOST_SHAPES) -> DataFrame:
    """All rows with host, path, rule (host and path of the rule that won, or null) and verdict; see names()."""
    text = F.concat("host", "path")
    rank = F.struct(F.char_length(text).alias("length"), F.char_length("host").alias("host_length"), (F.col("verdict") == "block").cast("int").alias("block"), text.alias("rule"), "verdict")
    shape = [(F.char_length("host") - F.char_length(F.replace("host", F.lit("."))) + 1).alias("labels"), F.char_length("path").alias("length")]
    rule = rules.select(*shape, _digest(text).alias("digest"), rank.alias("rank")).groupBy("labels", "length", "digest").agg(F.max("rank").alias("rank"))
    rule = rule.withColumn("short", F.substring("digest", 1, 8))
    shapes = [(r["labels"], r["length"], r["n"]) for r in rule.groupBy("labels", "length").agg(F.count("*").alias("n")).orderBy("labels", "length").collect()]  # a row per shape

    rest = F.coalesce(F.when(F.locate("://", quoted(url)) > 0, F.substr(quoted(url), F.locate("://", quoted(url)) + 3)), F.lit(""))
    rows = pages.select(F.struct(*[quoted(c) for c in pages.columns]).alias("record"), rest.alias("rest"))
    rows = rows.withColumn("authority", F.regexp_extract("rest", r"^[^/?#]*", 0))
    rows = rows.select("record", ascii_lower(F.col("authority")).alias("host"), F.expr("regexp_extract(substring(rest, char_length(authority) + 1), '^[^?#]*', 0)").alias("path"))
    if len(shapes) <= most_shapes and sum(n for *_, n in shapes) <= broadcast_rules:
        found = []
        for i, (labels, length, _) in enumerate(shapes):
            # Rules that share the short prefix are one entry, so the join keeps rows as they are.
            entry = rule.where((F.col("labels") == labels) & (F.col("length") == length)).groupBy(F.col("short").alias(f"short_{i}")).agg(F.collect_list(F.struct("digest", "rank")).alias(f"rules_{i}"))
            rows = rows.withColumn(f"digest_{i}", _digest(_expression(labels, length)))
            rows = rows.join(F.broadcast(entry), F.substring(f"digest_{i}", 1, 8) == F.col(f"short_{i}"), "left")
            found.append(_confirmed(f"rules_{i}", f"digest_{i}"))
        best = F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<rule:string,verdict:string>")
        judged = rows.withColumn("best", best)
    else:
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "urls")  # row numbers hold from here on
        asked = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(n).alias("length"), _digest(_expression(a, n)).alias("digest")) for a, n, _ in shapes])
        probes = rows.select("row", F.explode(F.filter(asked, lambda x: x["digest"].isNotNull())).alias("x")).select("row", "x.*").withColumn("short", F.substring("digest", 1, 8))
        side = F.broadcast(rule) if sum(n for *_, n in shapes) <= broadcast_rules else rule
        hits = probes.join(side.withColumnRenamed("digest", "full"), ["short", "labels", "length"]).where("digest = full")
        judged = rows.join(hits.groupBy("row").agg(F.max("rank").alias("best")), "row", "left")
    host, path, won, verdict = names(pages)
    return judged.select(*[F.col("record")[c].alias(c) for c in pages.columns], F.col("host").alias(host), F.col("path").alias(path), F.col("best.rule").alias(won), F.coalesce("best.verdict", F.lit(default)).alias(verdict))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path, rule, verdict = names(pages)
    return judge(pages, rules_frame(spark)).select("page_id", F.col(host).alias("host"), F.col(path).alias("path"), F.col(rule).alias("rule"), F.col(verdict).alias("verdict"))


OP7_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND (starts_with(path, '/en/1') OR starts_with(path, '/es/')) THEN 'block'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM split
"""
