"""Arrow helpers: batches cut to a bounded number of text bytes, and row-wise results as record batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_BYTES = 1 << 20


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run`` over a task's batches, after which the worker's free memory goes back to the system: workers outlive their tasks."""

    @functools.wraps(run)
    def of(*parts):
        try:
            yield from run(*parts)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return of


def blocks(batch: pa.RecordBatch, columns: int | tuple[int, ...], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, so that memory stays bounded."""
    each = [pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in np.atleast_1d(columns).tolist()]
    sizes = np.cumsum(sum(each))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
        yield batch.slice(at, end - at)
        at = end


def map_texts(docs: DataFrame, id_column: str, text_column: str, schema: StructType, make: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """(id, text) rows to (id, *values) rows; ``make`` builds a task's function from text to values. ``schema`` starts with the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for block in blocks(batch, 1):
                columns = list(zip(*map(of, block.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([block.column(0).cast(arrow[0].type)] + [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])], schema=arrow)

    return docs.select(F.col(id_column).cast(schema[0].dataType).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(lean(run), schema)
