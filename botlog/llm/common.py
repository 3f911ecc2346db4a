"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botlog.session import scratch_path, ship_package

#: Rows and bytes of one Arrow batch of whole texts: bound a Python worker's memory.
TEXT_BATCH_ROWS = 1000
TEXT_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``, read by Spark so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Workers can import this package and get small batches of texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read
    back: later reads are column-pruned and survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like :func:`written`, as a table bucketed by ``column``: to group it by
    that column does not shuffle it. The table lies in the shared checkpoint folder
    too; its name is only known to the session's catalog."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "t_" + path.rsplit("-", 1)[1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, column).option("path", path).saveAsTable(table)
    return spark.table(table)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished queries now:
    it follows the garbage collection of the driver's objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def utf8(col: str | Column) -> Column:
    """Text as UTF-8 bytes, null as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("binary"), F.lit(b""))


def text_hash(col: str = "text") -> Column:
    """Hash that tells texts of one id apart (null and empty alike)."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def bucket_of(col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: remainder 0
    of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def unused(columns, name: str) -> str:
    """``name``, lengthened until no column is called so (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers ``fn`` under its own name."""
    REGISTRY[fn.__name__] = fn
    return fn
