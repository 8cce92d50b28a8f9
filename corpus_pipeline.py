"""From documents to packed sequences: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and
rereads it as the docs of the next. All but the last return the columns of documents. Near duplicates are judged on
shingles of five words at a similarity of 0.8 or more, and the document with the smallest id of each group stays.

Cases: null texts and ids, empty texts, repeated rows and further columns pass the stages as the operators' docstrings
say; rows that repeat an id and its text become one, and an id's other texts are documents of their own. Very
long texts are taken whole. Columns beside those of documents pass too, whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, near_dedup, packing, quality, toxicity
from weftgraph.llm.common import free_name, quoted, stage, staged_count, staged_since, table, unstage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least quality.THRESHOLD."""
    score = free_name(docs, "_score")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).where(F.col(score) >= quality.THRESHOLD).drop(score)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below toxicity.THRESHOLD."""
    score = free_name(docs, "_score")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; documents without an id stay."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = stage(ids.where("n > 1").select("doc_id", F.lit(True).alias("repeated")), "repeated")
    if not repeated.isEmpty():
        return one_of_each_text(docs, repeated)
    groups = stage(near_dedup.near_duplicates(docs, width=5), "groups")
    later = groups.where("doc_id <> component").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def one_of_each_text(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The same where ids repeat: an id with several texts is several documents, ordered by the texts' digests."""
    record = docs.select("doc_id", "text", F.struct(*map(quoted, docs.columns)).alias("record"))
    flagged = record.join(repeated, "doc_id", "left").withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    for salt in itertools.count():
        key = F.when(F.col("repeated"), F.xxhash64(F.lit(salt), "doc_id", "digest")).otherwise(F.col("doc_id").cast("long"))
        keyed = stage(flagged.withColumn("row", key), "keyed")
        names = stage(keyed.where("row is not null").select("row", "doc_id", "digest").distinct(), "names")
        if names.groupBy("row").count().where("count > 1").isEmpty():
            break  # no two documents have one key
        unstage(keyed, names)
    groups = stage(near_dedup.near_duplicates(keyed, width=5, key="row"), "groups").where("row is not null").select("row", "component").distinct()
    first = groups.join(names, "row").groupBy("component").agg(F.min_by("row", F.struct("doc_id", "digest")).alias("first"))
    later = groups.join(first, "component").where("row <> first").select("row")
    kept = keyed.join(later, "row", "left_anti")
    # Rows of one id and text: the smallest of them stays.
    alone = kept.where("repeated is null").select("record")
    one = alone.union(kept.where("repeated").groupBy("row").agg(F.min("record").alias("record")).select("record"))
    return one.select(*[F.col("record")[c].alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_dedup", one_of_each), ("decontaminate", decontaminated), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        mark = staged_count()
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(*[x for x in staged_since(mark) if x is not docs])  # what the stage staged on its way
    return docs
