"""A table of keys in hash buckets: upserts and deletes rewrite touched buckets only, and a version file makes each change visible at once.

``folder``/data holds the buckets of each change, ``folder``/versions a small file a version: its number, the batch it came from and the folder of every
bucket. A version file is created last and never overwritten, so a reader sees a whole version, a lost writer leaves only unnamed data, and of two
writers of one version the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyedTable:
    """Rows of ``schema``, one for each ``keys``; ``buckets`` should grow with the table, as a bucket is rewritten by one task. Null keys are keys like others."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, list(keys)
        self.bucket = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def version(self) -> dict:
        """{"version", "batch", "buckets": {bucket: folder}} of the newest version."""
        numbers = sorted(int(n) for n in self._names("versions") if n.isdigit())
        if not numbers:
            return {"version": 0, "batch": -1, "buckets": {}}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/versions/{numbers[-1]}", wholetext=True).collect()))  # one small file

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The newest version, or its buckets ``only``."""
        held = self.version()["buckets"]
        paths = [f"{self.folder}/data/{d}/_bucket={b}" for b, d in held.items() if only is None or int(b) in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, rows: DataFrame, touched: Sequence[int], batch: int) -> None:
        before, name = self.version(), uuid.uuid4().hex
        rows.write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}")
        made = {n.split("=")[1]: name for n in self._names(f"data/{name}") if n.startswith("_bucket=")}
        kept = {b: d for b, d in before["buckets"].items() if int(b) not in set(touched)}
        text = json.dumps({"version": before["version"] + 1, "batch": max(batch, before["batch"]), "buckets": kept | made})
        out = self._fs.create(self._path(f"{self.folder}/versions/_{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.folder}/versions/{before['version'] + 1}")
        if self._fs.exists(target) or not self._fs.rename(self._path(f"{self.folder}/versions/_{name}"), target):
            raise RuntimeError(f"version {before['version'] + 1} was written by another writer")

    def upsert(self, new: DataFrame, by: Sequence[str], batch: int | None = None) -> list[int]:
        """The row of each key with the largest ``by`` stays, old ones included. Returns the rewritten buckets; a ``batch`` that is already in changes nothing."""
        if batch is not None and batch <= self.version()["batch"]:
            return []
        new = new.select(*self.read([]).columns).withColumn("_bucket", self.bucket)
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most the number of buckets
        both = new.unionByName(self.read(touched).withColumn("_bucket", self.bucket)).repartition("_bucket")
        rank = F.row_number().over(Window.partitionBy("_bucket", *self.keys).orderBy(*[F.desc(c) for c in by]))
        self._commit(both.withColumn("_rank", rank).where("_rank = 1").drop("_rank"), touched, -1 if batch is None else batch)
        return touched

    def delete(self, where: Column) -> int:
        """Removes rows for which ``where`` holds and returns their number; ``KeyError`` if there is none."""
        rows = self.read().withColumn("_bucket", self.bucket)
        counts = rows.where(where).groupBy("_bucket").count().collect()  # at most the number of buckets
        if not counts:
            raise KeyError("no row to delete")
        touched = [r["_bucket"] for r in counts]
        self._commit(self.read(touched).withColumn("_bucket", self.bucket).where(~F.coalesce(where, F.lit(False))).repartition("_bucket"), touched, -1)
        return sum(r["count"] for r in counts)

    def clean(self) -> None:
        """Deletes data that the newest version does not name, and older version files; not while others write or read older versions."""
        newest = self.version()
        for name in self._names("data"):
            if name not in set(newest["buckets"].values()):
                self._fs.delete(self._path(f"{self.folder}/data/{name}"), True)
        for name in self._names("versions"):
            if name != str(newest["version"]):
                self._fs.delete(self._path(f"{self.folder}/versions/{name}"), False)
