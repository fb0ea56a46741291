"""Best-fit packing: few-document length patterns, repeat counts by non-negative least squares, residuals by best fit.

The plan needs only the histogram of piece lengths, which has at most ``capacity`` entries whatever the
corpus size. Pieces are then ranked within their length (common lengths over salts, so that none is a single
group) and a piece's length and rank give its sequence and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import blocks, lean
from .bpe import CachedEncoder
from .common import written

#: Pieces of a length are ranked in groups: of at least so many rows, and about so many groups in all, so that their sizes can be broadcast.
LEAST_GROUP, GROUPS = 2_000, 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: only longer documents are cut, all pieces but the first are full.

    Null or empty text is one piece with the end id. Repeated rows give their pieces each; null doc_ids are kept.
    Extra columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder.load(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            for block in blocks(batch, 1):
                rows = []
                for doc, ids in zip(block.column(0).to_pylist(), encoder.encode(block.column(1).to_pylist())):
                    ids = np.frombuffer(ids + end, dtype=encoder.dtype).astype("<u4")
                    first = len(ids) % capacity or capacity
                    at = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(cut), PIECES)


def length_patterns(counts: np.ndarray, capacity: int, widest: int = 192) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths that fill a sequence; triples among the ``widest`` most mass-bearing lengths.

    ``widest`` bounds the candidates of the fit only: lengths outside it still pack, as pairs or residuals.
    """
    present = np.flatnonzero(counts)
    there = counts > 0
    out = [(int(capacity),)] if there[capacity] else []
    out += [(int(a), int(capacity - a)) for a in present if capacity > a >= capacity - a and there[capacity - a]]
    top = np.sort(present[np.argsort(-counts[present] * present, kind="stable")][:widest])
    for i, b in enumerate(top):
        a = top[i:]
        c = capacity - a - b
        ok = (c > 0) & (c <= b)
        a, c = a[ok], c[ok]
        out += [(int(x), int(b), int(z)) for x, z in zip(a[there[c]], c[there[c]])]
    return out


def fit_repeats(counts: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Non-negative least squares ``min |A x - counts|, x >= 0`` by accelerated projected gradient steps."""
    if not patterns:
        return np.zeros(0)
    row = np.concatenate([np.array(p) for p in patterns])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    forward = lambda x: np.bincount(row, weights=x[col], minlength=len(counts))
    back = lambda r: np.bincount(col, weights=r[row], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue of A'A
        v = back(forward(v / np.linalg.norm(v)))
    step, h = 1.0 / max(1.0, 1.05 * np.linalg.norm(v)), counts.astype(float)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0.0, y - step * back(forward(y) - h))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = z + (was - 1) / t * (z - x), z
    return x


def pack_plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every counted piece exactly once; at most a few thousand rows."""
    left, plan = counts.astype(np.int64).copy(), []
    patterns = length_patterns(counts, capacity)
    x = fit_repeats(counts, patterns)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        lengths, times = np.unique(patterns[k], return_counts=True)
        if r := int(min(round(float(x[k])), (left[lengths] // times).min())):
            left[lengths] -= r * times
            plan.append((patterns[k], r))
    while left.any():  # best fit for the rest, in bulk: every step uses up at least one length
        room, pattern, free = capacity, [], left.copy()
        while room > 0 and (fits := np.flatnonzero(free[1 : room + 1])).size:
            n = int(fits[-1]) + 1
            if pattern and (pair := _exact_pair(free, room)):
                pattern += pair
                break
            pattern.append(n)
            free[n] -= 1
            room -= n
        lengths, times = np.unique(pattern, return_counts=True)
        r = int((left[lengths] // times).min())
        left[lengths] -= r * times
        plan.append((tuple(pattern), r))
    return plan


def _exact_pair(free: np.ndarray, room: int) -> list[int] | None:
    """One or two lengths that fill ``room`` exactly, the largest first."""
    if free[room]:
        return [room]
    high = np.arange(room - 1, (room - 1) // 2, -1)
    low = room - high
    ok = (free[high] > 0) & (free[low] > (high == low))
    return [int(high[ok][0]), int(low[ok][0])] if ok.any() else None


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: pieces of a sequence lie gapless from 0 and sum to at most ``capacity``."""
    spark, columns = pieces.sparkSession, ["doc_id", "piece", "start", "length", "ids_crc32"]
    if "nr" not in pieces.columns:
        pieces = written(pieces.select(*columns, F.monotonically_increasing_id().alias("nr")), "numbered")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most one row per length
        counts[length] = n
    # only common lengths are dealt over salts: about GROUPS groups in all, whatever the number of pieces
    most = max(LEAST_GROUP, -(-int(counts.sum()) // GROUPS))
    salts = spark.createDataFrame([(int(n), int(-(-counts[n] // most))) for n in np.flatnonzero(counts)], "length long, salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("nr"), F.col("salts")).cast("int"))
    per = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "length_counts")
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used, base = np.zeros(capacity + 1, dtype=np.int64), 0
    for pattern, r in pack_plan(counts, capacity):
        at = 0
        for n in pattern:
            slots.setdefault(n, []).append((int(used[n]), base, at, n))
            used[n] += r
            at += n
        base += r
    lo, seq, off, span = (np.array([s[i] for n in sorted(slots) for s in slots[n]], dtype=np.int64) for i in range(4))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("nr")) - 1)
    ranked = ranked.join(F.broadcast(per.withColumn("before", before).drop("n")), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.searchsorted(span, np.arange(capacity + 2))
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            at = np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                rows = length == n
                at[rows] = starts[n] + np.searchsorted(lo[starts[n] : starts[n + 1]], rank[rows], "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq[at] + rank - lo[at]), pa.array(off[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select(*columns, F.col("rank").cast("long")).mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenises every document once and packs the pieces.

    Empty table: no rows. Null or empty text: one piece of one token. Ties in length are ordered by the number a
    piece got when it was written. Repeated rows are packed each. Null doc_ids are kept. Extra columns are ignored.
    Very long texts are encoded whole, one at a time.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("nr", F.monotonically_increasing_id())
    return pack(written(pieces, "pieces"), capacity)
