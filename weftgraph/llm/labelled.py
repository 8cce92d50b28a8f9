"""The labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import held_out, quoted

FOLDS = 5
#: At most so many bytes of text are learnt from, and from no text of more than a 64th of that.
SAMPLE_BYTES = 32 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int, text: str = "text", key: str = "doc_id", most_bytes: int = SAMPLE_BYTES, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, y, and what ``also`` names) of at most ``bound`` labelled documents and ``most_bytes`` of text, the first by a seeded hash of
    the id, held-out ones aside. An id is one row: of several texts the smallest by (size, hash), of several labels the
    largest. The bound keeps the ids small enough to broadcast, and what is learnt from small enough for the driver."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS))
    known = known.join(docs.select(quoted(key).alias("doc_id")), "doc_id", "left_semi")  # labels of other documents take no places
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    known = known.orderBy(order, "doc_id").limit(bound)
    rows = docs.select(quoted(key).alias("doc_id"), quoted(text).alias("text"), *[c.alias(n) for n, c in (also or {}).items()]).join(F.broadcast(known), "doc_id")
    size, print_ = F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text")
    light = rows.select("doc_id", size.alias("size"), print_.alias("print")).where(F.col("size") <= most_bytes // 64)
    one = light.groupBy("doc_id").agg(F.min(F.struct("size", "print")).alias("pick")).select("doc_id", "pick.*")
    so_far = F.sum("size").over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of at most bound rows
    chosen = one.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("doc_id", "print")
    picked = rows.withColumn("print", print_).join(F.broadcast(chosen), ["doc_id", "print"])
    return picked.dropDuplicates(["doc_id"]).select("doc_id", "text", "y", *(also or {}))
