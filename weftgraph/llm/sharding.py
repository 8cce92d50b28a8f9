"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets of bounded size with seeded hashes; pass two shuffles each
bucket by Fisher-Yates and lays the buckets of a shard end to end. A record's shard follows from its key and
the number of shards alone (the ``key`` law): each shard draws a seeded hash of the key and the highest draw
wins, so one more shard takes records only into itself.

Only DataFrame functions run here. A bucket is the unit of memory: a shard has as many as its own bytes ask for,
each of about ``bucket_bytes``, and each is one task of pass two. Buckets are dealt by a hash of key and row, so a
key that holds a third of all rows, which the law sends to one shard, fills many buckets of that shard evenly.

A bucket's rows are put in the order of their draws before they are shuffled, and a task's generator starts from the
seed and the task's number, which is the bucket's: a task that runs again after a lost executor gives the same slots.

Cases: null key: a shard of its own hash, as any other key. Null or empty text: size 1, crc32 0. Repeated rows: each
gets its own slot. Empty table: no rows. Very long texts: a bucket holds one text at least, whole. Other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import free_name, quoted, stage, table

BUCKET_BYTES = 16 << 20


def highest_draw(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the key is the highest."""
    draws = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.xxhash64(key)).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)])
    return F.array_max(draws)["shard"]


def names(docs: DataFrame) -> tuple[str, str, str]:
    """What shard() calls its columns on this table."""
    return free_name(docs, "_shard"), free_name(docs, "_slot"), free_name(docs, "_grown")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, bucket_bytes: int = BUCKET_BYTES, seed: int = 17) -> DataFrame:
    """All rows with their shard, slot and shard were there one more (see names()); the whole record moves."""
    dealt = docs.select(
        F.struct(*[quoted(c) for c in docs.columns]).alias("record"),
        highest_draw(quoted(key), shards, seed).alias("shard"),
        highest_draw(quoted(key), shards + 1, seed).alias("grown"),
        (F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("draw", F.xxhash64(F.lit(seed + 1), F.col("record")[key], F.col("row")))
    # The scatter is written once: row numbers of a second evaluation could differ, and counts with them.
    dealt = stage(dealt, "scatter")
    sizes = {r["shard"]: r["size"] for r in dealt.groupBy("shard").agg(F.sum("size").alias("size")).collect()}  # a row per shard
    buckets = [max(1, -(-sizes.get(s, 0) // bucket_bytes)) for s in range(shards)]
    first = [sum(buckets[:s]) for s in range(shards)]
    at = lambda x: F.element_at(F.array(*[F.lit(v) for v in x]), F.col("shard") + 1)
    dealt = dealt.withColumn("bucket", (at(first) + F.pmod(F.xxhash64(F.lit(seed + 2), F.col("draw")), at(buckets))).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ordered = F.array_sort(
        F.collect_list(F.struct("draw", "row", "record", "shard", "grown")),
        lambda a, b: F.when(a["draw"] < b["draw"], -1).when(a["draw"] > b["draw"], 1).when(a["row"] < b["row"], -1).otherwise(1),
    )
    filled = dealt.repartitionById(sum(buckets), F.col("bucket")).groupBy("bucket").agg(ordered.alias("rows"))
    mixed = filled.select("bucket", F.posexplode(F.expr(f"shuffle(rows, {seed})")).alias("place", "x")).join(F.broadcast(starts), "bucket")  # a row per bucket: records move once
    shard_, slot, grown = names(docs)
    return mixed.select(*[F.col("x.record")[c].alias(c) for c in docs.columns], F.col("x.shard").alias(shard_), (F.col("start") + F.col("place")).alias(slot), F.col("x.grown").alias(grown))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder per shard, records in slot order."""
    placed = shard(docs, **options)
    by, slot, _ = names(docs)
    placed.repartitionByRange(F.col(by), F.col(slot)).sortWithinPartitions(by, slot).write.partitionBy(by).parquet(path)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the ``key`` law, with size and crc32 taken from the record moved."""
    docs = table(spark, sf_dir, "documents")
    shard_, slot, grown = names(docs)
    return shard(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(shard_).cast("int").alias("shard"),
        F.col(slot).cast("long").alias("slot"),
        F.col(grown).cast("int").alias("grown_shard"),
    )
