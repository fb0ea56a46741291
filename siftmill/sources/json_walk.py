"""Any JSON as key and value lines: a depth-first walk of each document where it is read, without a shuffle."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a list, only so many items are walked where nothing else is asked for.
MOST_ITEMS = 500
BLOCK_BYTES = 1 << 20
_BLANK = "\t\n\v\f\r" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "Z")
_MAY_BE_BLANK = frozenset(("", "\x85", *_BLANK))
_READ = json.JSONDecoder(parse_int=str).decode  # whole numbers as they stand


def leaves_of(text: str | None, most: int | None = MOST_ITEMS) -> list[tuple[tuple[int, ...], str, str]]:
    """(places, path, value) of every leaf that is not blank, in order; values as Python prints them. A text that does not parse has none. ``most`` items of a list, all with None."""
    try:
        stack, out = [((), "", _READ(text))] if text is not None else [], []
    except ValueError:
        return []
    escaped = "\\u" in text if stack else False
    while stack:
        at, path, value = stack.pop()
        if type(value) is dict:
            stack += [((*at, i), path + k, v) for i, (k, v) in enumerate(value.items(), 1)][::-1]
        elif type(value) is list:
            stack += [((*at, i), f"{path}[{i}]", v) for i, v in enumerate(value[:most])][::-1]
        else:
            value = value if type(value) is str else str(value)
            if value[:1] in _MAY_BE_BLANK and _blank(value):
                continue
            out.append((at, *(s.encode("utf-8", "replace").decode() for s in (path, value))) if escaped else (at, path, value))  # half a pair prints as ?
    return out


def _blank(value: str) -> bool:
    """White space alone; a next-line sign may end it."""
    return not value.strip(_BLANK) or (value[-1] == "\x85" and not value[:-1].strip(_BLANK))


def _parsed(column: str) -> Column:
    """The text if Spark takes it for JSON: names given twice, NaN and the like are none."""
    return F.expr(f"CASE WHEN try_parse_json({column}) IS NOT NULL THEN CAST({column} AS string) END").alias("json")


def _by_blocks(of: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of`` over slices of a batch, the last column's texts ``BLOCK_BYTES`` at a time or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES)))
                yield of(batch.slice(at, end - at))
                at = end

    return run


def json_leaves(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, at, path, value) of every leaf of the JSON texts in ``column``, in the order ``at`` (array of places) of a depth-first walk.

    A path has the names without a separator and ``[i]`` for items of a list; of a list, the first ``MOST_ITEMS`` are walked. Names keep
    their order in the text. Blank leaves are left out; a null prints as None. Texts that do not parse have no leaves.
    A document has to fit in a task with its leaves.
    """

    def of(block: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *leaf) for k, text in enumerate(block.column(1).to_pylist()) for leaf in leaves_of(text)]
        row, at, path, value = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(path, pa.string()), pa.array(value, pa.string())], names=["key", "at", "path", "value"])

    return docs.select(F.col(key).alias("key"), _parsed(column)).mapInArrow(_by_blocks(of), f"key {docs.schema[key].dataType.simpleString()}, at array<int>, path string, value string")


def json_texts(docs: DataFrame, key: str, column: str, title: str, most: int | None = MOST_ITEMS) -> DataFrame:
    """(key, text, char_count): a heading, an empty line, and a line ``path: value`` for every leaf of a document; of a list, the first ``most`` items or all with None."""

    def of(block: pa.RecordBatch) -> pa.RecordBatch:
        lines = ["".join(f"\n{path}: {value}" for _, path, value in leaves_of(text, most)) for text in block.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(lines, pa.string())], names=["key", "title", "lines"])

    walked = docs.select(F.col(key).alias("key"), F.col(title).cast("string").alias("title"), _parsed(column)).mapInArrow(_by_blocks(of), f"key {docs.schema[key].dataType.simpleString()}, title string, lines string")
    # a heading without a title is left out, and a document without leaves ends with the empty line
    return walked.select("key", F.concat(F.coalesce(F.concat(F.lit("JSON Dataset: "), "title", F.lit("\n")), F.lit("")), "lines").alias("text")).withColumn("char_count", F.length("text").cast("long"))
