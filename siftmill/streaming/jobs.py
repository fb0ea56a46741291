"""Structured Streaming jobs over append-only event and file inputs; each shares its core with a batch query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADMITTED = "user_id long, event_id long, ts timestamp, admitted boolean"


def admit(stamps: list[int], held: list[int], seconds: int = 60, most: int = 30) -> tuple[list[bool], list[int]]:
    """Verdicts for ascending stamps (microseconds) and the stamps still held; rejected ones are not held."""
    out = []
    for at in stamps:
        held = [h for h in held if h > at - seconds * 1_000_000]
        out.append(len(held) < most)
        if out[-1]:
            held.append(at)
    return out, held


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


class Admission(StatefulProcessor):
    """Holds a user's admitted stamps of the last ``seconds``. A timer at the end of the latest stamp's time drops what is over, so that idle users leave the store."""

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "at long")

    def _keep(self, stamps: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stamps:
            self.held.put([(at,) for at in stamps])
            self.handle.registerTimer(max(stamps) // 1000 + self.seconds * 1000 + 1)
        else:
            self.held.clear()

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [at for (at,) in self.held.get()]
        new = pd.concat(rows).sort_values(["ts", "event_id"])  # one user's rows of one micro-batch
        verdict, held = admit(_micros(new["ts"]), held, self.seconds, self.most)
        self._keep(held)
        yield new.assign(admitted=verdict)[["user_id", "event_id", "ts", "admitted"]]

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        over = (timerValues.getCurrentWatermarkInMs() - self.seconds * 1000) * 1000
        self._keep([at for (at,) in self.held.get() if at > over])
        return iter(())

    def close(self) -> None:
        pass


def admission(events: DataFrame, seconds: int = 60, most: int = 30, late: str = "10 seconds") -> DataFrame:
    """Sliding admission of each user's requests: in a stream with state, else in one pass; the state is at most ``most`` stamps.

    A stream judges rows in the order of its micro-batches, within one by time; a user's state goes once the watermark (``late``) has passed its last stamp's time.
    """
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    if rows.isStreaming:
        rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Admission(seconds, most), ADMITTED, "append", "EventTime")

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, []  # rows come sorted, so the state of one user at a time is enough
        for batch in batches:
            verdict = []
            for own, at in zip(batch["user_id"].tolist(), _micros(batch["ts"])):
                if own != user:
                    user, held = own, []
                (ok,), held = admit([at], held, seconds, most)
                verdict.append(ok)
            yield batch.assign(admitted=verdict)

    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(once, ADMITTED)


def windowed_latency(events: DataFrame, width: str = "24 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Requests, mean latency, its median and 95th percentile (rank off by at most 1/10,000) and failures of each event-time window."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    d = rows.groupBy(F.window("ts", width, slide or width)).agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.percentile_approx("value", [0.5, 0.95], 10_000).alias("p"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return d.select(F.col("window.start").alias("window_start"), "n", "mean", F.round(F.col("p")[0], 3).alias("p50"), F.round(F.col("p")[1], 3).alias("p95"), "failures")


def fallback_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = events.where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width), (F.col("user_id") % 3).alias("reason")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "reason", "n")


def deduplicated(events: DataFrame, hash_of: F.Column, late: str = "30 days") -> DataFrame:
    """One row for each hash; a stream forgets hashes older than the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("hash", hash_of)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"]) if rows.isStreaming else rows.dropDuplicates(["hash"])


def latest_values(current: DataFrame | None, new: DataFrame, keys: list[str], by: str) -> DataFrame:
    """State after an upsert: the newest row of each key."""
    both = new if current is None else current.unionByName(new)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert_into(path: str, keys: list[str], by: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each version of the state to its own folder; a repeated batch overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}") if number else None
        latest_values(before, batch, keys, by).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def newest_into(path: str, order: list[F.Column], n: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the first ``n`` rows in ``order`` over all batches, a version a batch."""

    def write(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={number - 1}") if number else batch.limit(0)
        batch.unionByName(before).orderBy(*order).limit(n).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def latest_version(spark, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    return versions.where(F.col("version") == versions.agg(F.max("version")).head()[0]).drop("version")


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream of all that is there now through a ``foreachBatch`` function."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_folder(texts: DataFrame, path: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame]):
    """Starts the incremental ingest of a text stream: new files only, each chunked and appended once."""

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run_batches(texts, write, checkpoint)
