"""Shared folder, written intermediate tables and id handling for the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local session may leave that unset, and then the warehouse holds it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/siftmill-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def crc32_sql(text: str) -> str:
    """DuckDB text of the unsigned crc32 of a text's UTF-8 bytes, half a byte at a time; the sixteen steps follow from the polynomial."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = f"xor(c >> 4, list_extract({table}::BIGINT[], (xor(c & 15, d) + 1)::BIGINT))"
    halves = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: [strpos('0123456789ABCDEF', x[2]) - 1, strpos('0123456789ABCDEF', x[1]) - 1])"
    return f"xor(list_reduce(flatten({halves})::BIGINT[], lambda c, d: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, texts go to Python workers in Arrow batches of at most about ``BATCH_BYTES``."""
    was = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, was) if was is not None else spark.conf.unset(_BATCH)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes ``written`` tables that nothing reads any more; a collection in the driver lets Spark clear the shuffles behind them, too."""
    for table in tables:
        jvm, spark = table.sparkSession.sparkContext._jvm, table.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(spark: SparkSession) -> int:
    """Into how many buckets packed rows go: at least 64, so that a document gives as many rows on a small cluster as on a large one."""
    return max(64, partitions(spark))


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder stays for its owner to clear
            return
