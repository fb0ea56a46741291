"""Folder ingest as a stream of files with a log: each file has a status, and failed files are queued again.

``store``/chunks and ``store``/log are partitioned by ``run``. A run writes its chunks first and its log last; both are overwritten when the run is
repeated, and only chunks of logged runs count, so that a lost driver or a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.binary import READERS, Reader, assembled, file_parts, loads
from ..sources.stages import written

#: Texts (path, text, ..., error) to chunks (path, chunk, content); by parts, (path, position, text, ...) of each part to chunks.
Chunker = Callable[[DataFrame], DataFrame]
LOG = "path string, attempt int, status string, chunk_count long, error string, at long, run string"
CHUNKS = "path string, chunk int, content string, run string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def log(spark: SparkSession, store: str) -> DataFrame:
    """(path, attempt, status, chunk_count, error, at, run): a row for each attempt at a file."""
    return spark.read.schema(LOG).parquet(f"{store}/log") if _exists(spark, f"{store}/log") else spark.createDataFrame([], LOG)


def chunks(spark: SparkSession, store: str) -> DataFrame:
    """Chunks of completed attempts."""
    if not _exists(spark, f"{store}/chunks"):
        return spark.createDataFrame([], CHUNKS).drop("run")
    done = log(spark, store).where("status = 'completed'").select("path", "run")
    return spark.read.schema(CHUNKS).parquet(f"{store}/chunks").join(done, ["path", "run"], "left_semi").drop("run")


def latest(spark: SparkSession, store: str) -> DataFrame:
    """The last attempt at each file."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("attempt")))
    return log(spark, store).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def ingest(files: DataFrame, store: str, run: str, at: int, chunk: Chunker, readers: Mapping[str, Reader] = READERS, by_part: bool = False) -> None:
    """One attempt at each of ``files`` (path, content; path alone where no reader loads files) under the name ``run``. ``by_part``, no file is put together."""
    spark = files.sparkSession
    before = log(spark, store).where(F.col("run") != run).groupBy("path").agg(F.max("attempt").alias("tried"), F.max(F.col("status") == "completed").alias("done"))
    parts = file_parts(files.join(before.where("done"), "path", "left_anti"), readers)
    texts = parts.select("path", "part", "position", F.col("value").alias("text"), "error") if by_part else assembled(parts)
    texts.write.mode("overwrite").parquet(f"{store}/texts/run={run}")
    texts = spark.read.schema(texts.schema).parquet(f"{store}/texts/run={run}")
    tried = texts.groupBy("path").agg(F.max("error").alias("error")) if by_part else texts.select("path", "error")
    whole = texts.where("error IS NULL")
    if by_part:  # parts that came before an error do not count
        whole = whole.join(F.broadcast(tried.where("error IS NOT NULL").select("path")), "path", "left_anti")
    chunk(whole).select("path", F.col("chunk").cast("int").alias("chunk"), "content").write.mode("overwrite").parquet(f"{store}/chunks/run={run}")
    made = spark.read.schema("path string").parquet(f"{store}/chunks/run={run}").groupBy("path").agg(F.count("*").alias("chunk_count"))
    rows = tried.join(made, "path", "left").join(before, "path", "left").select(
        "path", (F.coalesce("tried", F.lit(0)) + 1).cast("int").alias("attempt"), F.when(F.col("chunk_count") > 0, "completed").otherwise("failed").alias("status"),
        F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), F.coalesce("error", F.when(F.col("chunk_count").isNull(), "no chunks")).alias("error"), F.lit(at).cast("long").alias("at"),
    )
    rows.write.mode("overwrite").parquet(f"{store}/log/run={run}")


def watch(spark: SparkSession, folder: str, store: str, chunk: Chunker, readers: Mapping[str, Reader] = READERS, files_a_batch: int = 1000, by_part: bool = False) -> StreamingQuery:
    """Starts the ingest of all files that are new below ``folder``, ``files_a_batch`` at a time."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    one = lambda batch, number: ingest(batch, store, f"batch-{number}", number, chunk, readers, by_part)
    return files.select("path", *["content"] * loads(readers)).writeStream.foreachBatch(one).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()


def retry(spark: SparkSession, store: str, chunk: Chunker, readers: Mapping[str, Reader] = READERS, most_attempts: int = 5, files_a_run: int = 1000, by_part: bool = False) -> int:
    """Another attempt at every file whose last one failed, ``files_a_run`` at a time; files with ``most_attempts`` and files that are gone wait. Returns the number of tries."""
    number, tried, after = log(spark, store).agg(F.count_distinct("run")).head()[0], 0, ""
    # fixed before the first run, which changes the log
    queue = written(latest(spark, store).where((F.col("status") == "failed") & (F.col("attempt") < most_attempts)).select("path"), "queue")
    while True:
        paths = [r["path"] for r in queue.where(F.col("path") > after).orderBy("path").limit(files_a_run).collect()]  # one run's names; the rest stay in the queue
        if not paths:
            return tried
        there = [p for p in paths if _exists(spark, p)]
        if there:
            ingest(spark.read.format("binaryFile").load(there).select("path", *["content"] * loads(readers)), store, f"retry-{number}", number, chunk, readers, by_part)
        number, tried, after = number + 1, tried + len(there), paths[-1]
