"""Files of any kind as parts: a reader for each suffix turns a file's bytes into (part, position, value) rows.

A file is one value of ``binaryFile`` and so has to fit in a task (2 GB at most); many files are read side by side. Spark does not list
files of no bytes. Readers are plain
functions of (title, bytes) and can be replaced or added, as for pages of formats that this library cannot open. A ``Streamed`` reader takes
the open file instead, and its parts are passed on as they come, so that a part has to fit in a task and not its file.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_page_lines, script_language
from .json_walk import json_texts
from .stages import spread


@dataclass(frozen=True)
class Streamed:
    """A reader of (title, open file). Where all readers are such, no file is loaded."""

    read: Callable[[str, BinaryIO], Iterable[tuple[str, int, str]]]


Reader = Callable[[str, bytes], Iterable[tuple[str, int, str]]] | Streamed
#: Bytes of a file read at once, and characters of parts passed on at once.
BLOCK = 1 << 20
PARTS = "path string, part string, position long, value string, error string"


def text_parts(title: str, content: bytes) -> Iterable[tuple[str, int, str]]:
    """The whole text; bytes that are no UTF-8 are left out."""
    return [("text", 0, content.decode("utf-8", "ignore"))]


def page_parts(title: str, content: bytes) -> Iterable[tuple[str, int, str]]:
    """Pages of a text between form feeds."""
    return [("page", i, page) for i, page in enumerate(content.decode("utf-8", "ignore").split("\f"))]


def stream_pages(title: str, file: BinaryIO) -> Iterable[tuple[str, int, str]]:
    """``page_parts`` of an open file, a page at a time."""
    held: list[bytes] = []
    i = 0
    while block := file.read(BLOCK):
        first, *pages = block.split(b"\f")
        held.append(first)
        for page in pages:
            yield "page", i, b"".join(held).decode("utf-8", "ignore")
            held, i = [page], i + 1
    yield "page", i, b"".join(held).decode("utf-8", "ignore")


def csv_parts(title: str, content: bytes) -> Iterable[tuple[str, int, str]]:
    """Name, columns and number of records, then a line ``name: value | ...`` for each record; lines that do not fit are left out, null and blank cells too."""
    d = pd.read_csv(io.BytesIO(content), encoding="utf-8", on_bad_lines="skip")
    yield "header", 0, f"Dataset: {title}\nColumns: {', '.join(map(str, d.columns))}\nTotal records: {len(d)}\n"
    for i, row in enumerate(d.astype(object).itertuples(index=False, name=None)):
        line = " | ".join(f"{c}: {v}" for c, v in zip(d.columns, row) if pd.notna(v) and str(v).strip())
        if line:
            yield "record", i + 1, line


def npz_parts(title: str, content: bytes) -> Iterable[tuple[str, int, str]]:
    """A header, and for each array its shape, type, extremes, mean, deviation and first five values, or ten of its distinct texts in order.

    Arrays of Python objects are named and not opened, since opening them would run code from the file.
    """
    with np.load(io.BytesIO(content), allow_pickle=False) as data:
        yield "header", 0, f"NumPy Dataset: {title}\nArrays contained: {', '.join(data.files)}\n"
        for i, name in enumerate(data.files):
            try:
                a = data[name]
            except ValueError:
                yield name, i + 1, f"Array: {name}\n  Data type: object\n"
                continue
            lines = [f"Array: {name}", f"  Shape: {a.shape}", f"  Data type: {a.dtype}"]
            if a.dtype.kind in "fiu" and a.size:
                flat = a.ravel()
                lines += [f"  {label}: {float(of(flat)):.6g}" for label, of in (("Min", np.min), ("Max", np.max), ("Mean", np.mean), ("Std", np.std))]
                lines.append(f"  Sample values: {flat[:5].tolist()}")
            elif a.dtype.kind in "US":
                lines.append(f"  Unique values (sample): {np.unique(a)[:10].tolist()}")
            yield name, i + 1, "\n".join(lines) + "\n"


READERS: dict[str, Reader] = {".txt": text_parts, ".csv": csv_parts, ".npz": npz_parts, ".pdf": page_parts}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def title(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def loads(readers: Mapping[str, Reader]) -> bool:
    """Whether any reader takes a file's bytes."""
    return not all(isinstance(r, Streamed) for r in readers.values())


def _store(uri: str) -> tuple[Any, str]:
    """File system and path of a path as Spark names it."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def file_parts(files: DataFrame, readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """(path, part, position, value, error) of files (path, content; path alone where no reader ``loads``). A file that no reader takes, or whose reader
    fails, gives a row with an error and no value, and no other, but for parts that a ``Streamed`` reader gave before it failed."""
    readers = dict(readers)

    def parts(name: str, kind: str, content: bytes) -> list[tuple]:
        if kind not in readers:
            return [(None, None, None, f"unsupported type {kind or 'none'}")]
        try:
            return [(*row, None) for row in readers[kind](name, bytes(content))]
        except Exception as e:  # a bad file is a row of the log, whatever its reader raises
            return [(None, None, None, f"{type(e).__name__}: {e}"[:300])]

    def streamed(name: str, path: str, reader: Streamed) -> Iterator[tuple]:
        try:
            store, at = _store(path)
            with store.open_input_stream(at, compression=None) as file:
                for row in reader.read(name, file):
                    yield (*row, None)
        except Exception as e:  # as above
            yield None, None, None, f"{type(e).__name__}: {e}"[:300]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, name, kind, content in batch.itertuples(index=False, name=None):
                reader, held, size = readers.get(kind), [], 0
                for row in streamed(name, path, reader) if isinstance(reader, Streamed) else parts(name, kind, content):
                    held.append((path, *row))
                    size += len(row[2] or "")
                    if size >= BLOCK and isinstance(reader, Streamed):
                        yield pd.DataFrame(held, columns=["path", "part", "position", "value", "error"])
                        held, size = [], 0
                yield pd.DataFrame(held, columns=["path", "part", "position", "value", "error"])

    named = (F.col("path"), title(F.col("path")).alias("title"), suffix(F.col("path")).alias("suffix"))
    if not loads(readers):
        return spread(files.select("path"), "path").select(*named, F.lit(None).cast("binary").alias("content")).mapInPandas(run, PARTS)
    return files.select(*named, "content").mapInPandas(run, PARTS)


def assembled(parts: DataFrame) -> DataFrame:
    """(path, title, language, text, page_count, char_count, error): a file's parts in order as one text. Pages are cleaned first and blank ones left out."""
    page = F.col("part") == "page"
    value = F.when(page, clean_page_lines(F.col("value"))).otherwise(F.col("value"))
    kept = F.col("error").isNull() & (~page | ~F.col("value").rlike(r"^[\s\p{Z}]*$"))
    d = parts.withColumn("value", value).groupBy("path").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("position", "value")))).alias("v"), F.max(F.when(page, 1)).alias("paged"), F.max("error").alias("error"))
    text = F.when(F.col("error").isNull(), F.when(F.col("paged") == 1, F.array_join("v.value", "\n\n")).otherwise(F.array_join("v.value", "\n")))
    d = d.select("path", title(F.col("path")).alias("title"), text.alias("text"), F.when(F.col("paged") == 1, F.size("v")).otherwise(1).alias("page_count"), "error")
    return d.select("path", "title", script_language(F.coalesce("text", F.lit("")), 1000).alias("language"), "text", "page_count", F.length("text").alias("char_count"), "error")


def extracted(spark: SparkSession, folder: str, readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """Every file below ``folder`` through the branch of its suffix, as ``assembled`` gives them: JSON by the walk, with all items of its lists, others by their readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    json = suffix(F.col("path")) == ".json"
    texts = files.where(json).select("path", title(F.col("path")).alias("title"), F.col("content").cast("string").alias("json"))
    walked = json_texts(texts, "path", "json", "title", most=None).select(F.col("key").alias("path"), title(F.col("key")).alias("title"), script_language(F.substring("text", 1, 1000), 1000).alias("language"), "text", F.lit(1).alias("page_count"), F.col("char_count").cast("int").alias("char_count"), F.lit(None).cast("string").alias("error"))
    return assembled(file_parts(files.where(~json), readers)).unionByName(walked)


def _named(spark: SparkSession, folder: str) -> str:
    """A folder as Spark names it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())


def write_files(files: DataFrame, folder: str) -> str:
    """Writes ``content`` of each row to ``folder``/``name``; a repeated task writes the same file again. Returns the folder as Spark names it."""
    base = _named(files.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(base)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                store.create_dir(f"{root}/{name}".rsplit("/", 1)[0])
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("name", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return base


def write_pages(pages: DataFrame, folder: str) -> str:
    """Writes the ``page`` texts of each ``name`` to one file ``folder``/``name``, in any order, a form feed after each. A page has to fit in a task, not its file.

    A repeated task writes the same files again. Returns the folder as Spark names it.
    """
    base = _named(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(base)
        last, out = None, None
        try:
            for batch in batches:
                for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if name != last:
                        if out:
                            out.close()
                        store.create_dir(f"{root}/{name}".rsplit("/", 1)[0])
                        last, out = name, store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(page.as_buffer())
                    out.write(b"\f")
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    rows = pages.select("name", F.coalesce(F.col("page").cast("binary"), F.lit(b"")).alias("page"))
    spread(rows, "name").sortWithinPartitions("name").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return base
