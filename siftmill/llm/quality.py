"""Quality rules with compression bands: zstandard ratios of whole documents and fixed chunks.

Repetitive text compresses to less, noise to more, than running text of the same length does, so each
length band (a power of two of bytes) has its own lowest and highest ratio. A document is rejected if its
whole ratio leaves its band or more than ``MOST_ODD`` of its fixed chunks leave theirs.

The limits are fitted: exact quantiles of the ratios of all documents labelled good, widened by a share of their
distance. Bands with too few labelled documents keep the wide fixed limits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import exact_quantiles
from .arrow import blocks, lean, map_texts
from .common import written

CHUNK, MOST_ODD, LEVEL = 2048, 0.3, 3
#: The fit: how many labelled documents a band needs, the outer quantiles, and how far limits lie beyond them.
LEAST, TAIL, MARGIN = 30, 0.005, 0.4
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_L, _B, _D = T.LongType(), T.BooleanType(), T.DoubleType()
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", _L), ("n_words", _L), ("word_chars", _L), ("n_symbols", _L), ("n_dup_lines", _L), ("n_repeat_words", _L), ("base_failed", _B), ("kept", _B), ("reason", T.StringType()), ("ratio", _D), ("odd_chunks", _D))])


class Limits(NamedTuple):
    """Lowest and highest ratio of whole texts by band, and of chunks."""

    whole: dict[int, tuple[float, float]] = {}
    chunk: tuple[float, float] = (0.20, 0.74)

    def of(self, size: int) -> tuple[float, float]:
        band = band_of(size)
        return self.whole.get(band) or WIDE[max(0, min(band, 14) - 8)]


#: Bands of 2^8, 2^9, ... 2^14 bytes and more, as long as nothing is fitted.
WIDE = ((0.30, 0.95), (0.26, 0.85), (0.20, 0.74), (0.20, 0.74), (0.16, 0.70), (0.16, 0.70), (0.12, 0.68))


def band_of(size: int) -> int:
    return size.bit_length() - 1


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    n, covered, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if n[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def ratios(data: bytes, compress) -> tuple[float | None, list[float]]:
    """(ratio of the whole, ratios of its chunks). Chunks have ``CHUNK`` bytes each; the last one ends with the text."""
    at = list(range(0, len(data) - CHUNK + 1, CHUNK))
    if len(data) > CHUNK and len(data) % CHUNK:
        at.append(len(data) - CHUNK)
    return len(compress(data)) / len(data) if data else None, [len(compress(data[i : i + CHUNK])) / CHUNK for i in at]


def verdict(size: int, ratio: float | None, chunks: list[float], limits: Limits) -> tuple[str | None, float]:
    """(why a text is rejected or None, share of its chunks outside their limits)"""
    low, high = limits.of(size)
    odd = sum(not limits.chunk[0] <= r <= limits.chunk[1] for r in chunks) / len(chunks) if chunks else 0.0
    if ratio is not None and ratio < low:
        return "repetitive", odd
    if ratio is not None and ratio > high:
        return "incompressible", odd
    return "chunks" if odd > MOST_ODD else None, odd


def measure(text: str | None, compress, limits: Limits) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    ratio, chunks = ratios(data, compress)
    reason, odd = verdict(len(data), ratio, chunks, limits)
    reason = "base" if failed else reason
    chars = len(text or "") - (len(data) - len(data.translate(None, _SPACE)))
    return len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, reason is None, reason, ratio, odd


def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress


def fit_limits(docs: DataFrame, labels: DataFrame, tail: float = TAIL, margin: float = MARGIN) -> Limits:
    """Limits from all documents labelled good (``labels``: doc_id, quality; 1 is good) that pass the base rules.

    Ratios are measured where the texts are and then joined with the labels, so no text is shuffled; the quantiles
    are exact. A doc_id labelled both ways does not count. One row a band comes to the driver.
    """
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("good_id")).agg(F.min("quality").alias("q")).where("q = 1").select("good_id")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressor()
        for batch in batches:
            for block in blocks(batch, 1):
                ids, band, found = [], [], []
                for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    words = data.split()
                    if len(words) >= 50 and 100 * repeated_words(words) <= 50 * len(words):
                        ratio, chunks = ratios(data, compress)
                        ids.append(doc)
                        band.append(band_of(len(data)))
                        found.append([ratio, *chunks])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(band, pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["good_id", "band", "ratios"])

    measured = texts.mapInArrow(lean(run), "good_id long, band int, ratios array<double>").join(good, "good_id")
    rows = measured.select(F.col("band").alias("of"), F.posexplode("ratios").alias("place", "value"))
    counts = written(rows.groupBy(F.when(F.col("place") == 0, F.col("of")).otherwise(-1).alias("band"), "value").agg(F.count("*").alias("n")), "ratios")
    ends = exact_quantiles(counts, ["band"], {"low": tail, "high": round(1 - tail, 9)})
    rows = counts.groupBy("band").agg(F.sum("n").alias("n")).join(ends, "band").collect()  # a row a band
    fitted = {r["band"]: (r["low"] - margin * (r["high"] - r["low"]), r["high"] + margin * (r["high"] - r["low"])) for r in rows if r["n"] >= LEAST}
    chunk = fitted.pop(-1, Limits().chunk)
    return Limits(fitted, chunk)


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts, ratios and verdict for every row; ``reason`` is base, repetitive, incompressible, chunks or null.

    Null and empty text: no words, so ``base_failed``; ratio null. Repeated rows: one result each. Null doc_id
    is kept. Extra columns are ignored. Empty table: no rows. Very long texts are measured whole, one at a time.
    """

    def make():
        compress = _compressor()
        return lambda text: measure(text, compress, limits)

    return map_texts(docs, "doc_id", "text", SCHEMA, make)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged; the verdict is computed beside the row, so nothing is shuffled.

    Null and empty texts go, as they have no words. Repeated rows fare alike, and rows with a null doc_id are
    judged like others. Empty table: no rows.
    """

    @F.pandas_udf(T.BooleanType())
    @lean
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compress = _compressor()
        for texts in batches:
            yield texts.map(lambda t: measure(t, compress, limits)[6]).astype(bool)

    return docs.where(passes(F.col("text").cast("string")))
