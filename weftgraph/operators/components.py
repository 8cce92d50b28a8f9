"""Connected components, for families of methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.staging import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, head) for every node on a link (a, b): the smallest node of its component. Each round, every node takes the
    smallest head among its neighbours', and then that head's head, so chains shorten by doubling."""
    pairs = links.where("a <> b")
    both = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    heads = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("head")))
    while True:
        seen = both.join(heads, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "head")
        lower = seen.union(heads).groupBy("node").agg(F.min("head").alias("head"))
        up = heads.select(F.col("node").alias("up"), F.col("head").alias("top"))
        after = checkpointed(lower.join(up, F.col("head") == F.col("up")).select("node", F.least("head", "top").alias("head")))
        was = heads.withColumnRenamed("head", "was").hint("merge")  # a row per node is no broadcast, however small its file
        if after.join(was, "node").where("head <> was").isEmpty():
            return after
        heads = after
