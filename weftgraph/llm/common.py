"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; one of our own only where driver and executors are one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="weftgraph-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


_staged: list[DataFrame] = []


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Nothing reads the shuffles behind a staged table again, so their files go as soon as it is written.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.weft_path = path
    _staged.append(out)
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.weft_path)
        path.getFileSystem(conf).delete(path, True)
        _staged[:] = [x for x in _staged if x is not df]


def staged_since(mark: int) -> list[DataFrame]:
    """The staged tables beyond the first ``mark`` (staged_count() of then) that are still there."""
    return _staged[mark:]


def staged_count() -> int:
    return len(_staged)


@atexit.register
def _clear() -> None:
    """Results are lazy and may read staged tables to the end of the session; what is left goes then, if Spark still runs."""
    for df in list(_staged):
        if df.sparkSession.sparkContext._jsc is not None:
            unstage(df)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many more underscores in front as keep it apart from the columns of df (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_numbers(df: DataFrame, key: str) -> None:
    """Raises, before any job runs, where ids aren't whole numbers: they would fail later or turn into nulls."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids in {key} must be whole numbers, not {kind}")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take lower(), which is the same there and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column, folds: int) -> Column:
    return crc_of_id(doc_id) % F.lit(folds) == 0


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def positional(df: DataFrame) -> DataFrame:
    """The same with plain names: mapInArrow takes no columns with dots in theirs."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def map_arrow(df: DataFrame, schema: str, f: Callable) -> DataFrame:
    """mapInArrow with a function from one record batch to a dict of columns of the schema."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def over(batches):
        for b in batches:
            if b.num_rows:
                out = f(b)
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return positional(df).mapInArrow(over, schema)
