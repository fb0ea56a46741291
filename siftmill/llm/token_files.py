"""Token-ID / binary output: flat unsigned integer files plus 64-bit document offsets.

Layout in one folder: ``ids-NNNNNN.bin`` holds the ids of one range of doc_id, one document after the
other; ``offsets-NNNNNN.bin`` holds n+1 signed 64-bit positions in it; ``docs-NNNNNN.bin`` the n doc_ids;
``manifest`` (Parquet) one row per part with its counts, the bytes of an id and the format's version. A part's
base in the whole sequence is the prefix sum of the parts before it. All are little-endian and can be memory-mapped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import blocks, lean
from .bpe import CachedEncoder
from .common import shared_dir, small_batches

VERSION = 1
MANIFEST = "part int, n_null long, n_docs long, n_tokens long, id_bytes int, version int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark's own file system layer names it, so that plain paths mean the same to Spark and to Arrow."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a qualified folder, and the path in it; it knows S3 by its plain scheme."""
    scheme, rest = folder.split(":", 1)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, text: str = "text") -> str:
    """Encodes every text, appends ``end_id``, writes the files in ascending ``doc_id`` order; returns the folder.

    Null or empty text: only the end id. Null doc_id: first, in text order. Repeated rows: one entry each.
    Extra columns are ignored. An empty table gives a manifest without rows. Parts are written under
    an attempt's own name and renamed, so a lost or repeated task leaves one whole part. Very long texts are encoded
    whole, one at a time.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder or shared_dir(spark))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = CachedEncoder.load(tokenizer), TaskContext.get()
        part, own = context.partitionId(), f"{context.taskAttemptId()}"
        store, root = _store(folder)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        ids, lengths, nulls, out = [], [], 0, None
        for batch in batches:
            for block in blocks(batch, 1):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/tmp-{own}-ids")
                nulls += block.column(0).null_count
                ids.append(block.column(0).fill_null(0).to_numpy())
                coded = encoder.encode(block.column(1).to_pylist())
                lengths.append(np.array([len(c) for c in coded], dtype=np.int64) // encoder.dtype.itemsize + 1)
                out.write(end.join(coded) + end)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        for name, data in (("offsets", offsets), ("docs", np.concatenate(ids).astype("<i8"))):
            with store.open_output_stream(f"{root}/tmp-{own}-{name}") as f:
                f.write(data.tobytes())
        for name in ("offsets", "docs", "ids"):
            store.move(f"{root}/tmp-{own}-{name}", f"{root}/{name}-{part:06d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())] + [pa.array([int(x)], pa.int64()) for x in (nulls, len(offsets) - 1, offsets[-1])] + [pa.array([x], pa.int32()) for x in (encoder.dtype.itemsize, VERSION)], names=["part", "n_null", "n_docs", "n_tokens", "id_bytes", "version"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lean(write), MANIFEST)
    with small_batches(spark):
        parts.write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, read back from the memory-mapped files: its place, length and crc32 of its ids.

    The manifest says how wide an id is. Off the local disk a part is read in pieces of ``20_000`` documents.
    """
    found = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/manifest").collect())  # a row per part, none per document
    base = np.concatenate([[0], np.cumsum([r[3] for r in found])]).astype(np.int64)
    parts = [(r[0], r[1], int(b)) for r, b in zip(found, base)]
    folder, kinds = _qualified(spark, folder), {tuple(r[4:6]) for r in found}
    if not kinds <= {(2, VERSION), (4, VERSION)} or len(kinds) > 1:
        raise ValueError(f"token files of unknown or mixed formats (bytes of an id, version): {sorted(kinds)}")
    dtype = f"<u{max(kinds)[0] if kinds else 4}"

    def load(store, path: str, kind: str, first: int = 0, last: int | None = None) -> np.ndarray:
        if store.type_name == "local":
            return np.memmap(path, dtype=kind, mode="r")[first:last]
        size = np.dtype(kind).itemsize
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read_at(((last - first) * size) if last is not None else f.size() - first * size, first * size), dtype=kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part, nulls, first = parts[k]
                offsets, docs = (load(store, f"{root}/{n}-{part:06d}.bin", "<i8") for n in ("offsets", "docs"))
                for at in range(0, len(docs), 20_000):
                    o = offsets[at : at + 20_001]
                    ids = load(store, f"{root}/ids-{part:06d}.bin", dtype, int(o[0]), int(o[-1]))
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(o[:-1] - o[0], o[1:] - o[0])]
                    n = len(crc)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(docs[at : at + n], dtype=np.int64), mask=np.arange(at, at + n) < nulls),
                            pa.array(np.asarray(o[:-1] + first)), pa.array(np.diff(o)), pa.array(crc, pa.int64()), pa.array(np.full(n, part, np.int32)),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(lean(read), ROWS)
