"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark takes a Parquet file's bytes for a table's size. Ids and names unpack to thirty times as many and more, so one
#: of under 10 MB went to the driver for a broadcast as 310 MB (Snappy; Zstandard files are some three times smaller yet);
#: while a table is staged, sizes count so many times.
UNPACKED = 128
#: While a table is staged. Shuffles behind it go as soon as it lies there, instead of when the driver collects garbage.
STAGING = {"spark.sql.sources.fileCompressionFactor": str(UNPACKED), "spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_tables: list[tuple[DataFrame, str]] = []


def shared_dir(df: DataFrame) -> str:
    """The checkpoint folder of the session; one of our own only where driver and executors are one machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="weftgraph-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


@contextmanager
def held(spark: SparkSession, **conf: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def checkpointed(df: DataFrame, **options: int) -> DataFrame:
    """Written as Parquet and reread: later plans prune its columns and choose joins by its real size, and a lost executor
    costs nothing."""
    path = f"{shared_dir(df)}/graph-{uuid.uuid4().hex}"
    with held(df.sparkSession, **STAGING):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables.append((out, path))
    return out


@atexit.register
def _clear() -> None:
    """Results are lazy and may read their tables to the end of the session; they go then, if Spark still runs."""
    for df, path in _tables:
        sc = df.sparkSession.sparkContext
        if sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
