"""Places of rows in the order of their group, by ranges: no group has to fit in a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrow import lean
from .common import partitions, written


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with ``_at``, a row's place in the run of its group within this task."""
    group, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0)
        new = np.concatenate([[True], pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)])
        starts = np.flatnonzero(new)
        base = np.zeros(len(starts), np.int64)
        if column[0].as_py() == group:
            base[0] = seen
        sizes = np.diff(np.append(starts, batch.num_rows))
        at = np.arange(batch.num_rows) - np.repeat(starts - base, sizes)
        group, seen = column[batch.num_rows - 1].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "_at"])


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place in the order of their ``group`` (not null) from 0, and ``n``, its rows.

    Rows equal in ``order`` stand as the input has them, so ``rows`` should be a written table. A group is spread over as many ranges
    as it has rows for, rows equal in ``order`` too; what is summed up is a row for each range and group.
    """
    spark = rows.sparkSession
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), group, *order, "_tie")
    ranged = ranged.sortWithinPartitions(group, *order, "_tie").drop("_tie").select(group, *[c for c in rows.columns if c != group], F.spark_partition_id().alias("_part"))
    placed = written(ranged.mapInArrow(lean(_counted), StructType([*ranged.schema, StructField("_at", LongType())])), name)
    own = Window.partitionBy(group)
    sizes = placed.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(group, "_part", before.alias("_base"), F.sum("_rows").over(own).alias("n"))
    return placed.join(bases, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_base")).drop("_at", "_base", "_part")
