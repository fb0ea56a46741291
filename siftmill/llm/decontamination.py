"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, each text scanned once.

The automaton holds every run of ``width`` consecutive item words (the whole item if shorter). Hits are
reported as word runs and as code point spans of the original text. Windows are made and put together in
Spark. Those of a very large benchmark are dealt by hash into blocks of bounded size, each with an automaton
of its own, and the texts pass the blocks one after the other, once each: a row's hits are carried beside it, so
that one block or many give the same rows. A further block costs another write of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import blocks, lean
from .common import written
from .words import alnum_words, char_offsets, spaced, word_bounds

#: Characters of windows and item ids in a block; an automaton takes about 50 bytes for each.
BLOCK = 2 << 20
_I, _S = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", _I), T.StructField("items", _S), T.StructField("spans", _I)])


def windows_of(text: str | None, width: int) -> list[tuple[str, int]]:
    """(spaced window, its number of words) of an item, in order."""
    words = alnum_words(text)[1]
    starts = range(max(1, len(words) - width + 1) if words else 0)
    return [(spaced(part), len(part)) for i in starts for part in [words[i : i + width]]]


def window_table(benchmark: DataFrame, width: int) -> DataFrame:
    """A row for each different window: key, n words, sorted items that have it. Items of any length are spread over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = windows_of(text, width)
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array([k for k, _ in part]), pa.array([n for _, n in part], pa.int32())], names=["item", "key", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(lean(run), "item string, key string, n int").groupBy("key", "n").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("None")))).alias("items"))


def automaton(windows: list[tuple[str, int, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, n, items in windows:
        a.add_word(key, (n, items))
    if windows:
        a.make_automaton()
    return a


def scan(text: str | None, machine) -> tuple:
    """(number of words, flat [start, end) word runs, item ids, flat [start, end) code point spans)"""
    data, words = alnum_words(text)
    hits = list(machine.iter(spaced(words))) if words and len(machine) else []
    if not hits:
        return len(words), [], [], []
    starts, ends = word_bounds(data)
    line = np.concatenate([[0], np.cumsum(ends - starts + 1)])  # where the space before each word stands
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    items: set[str] = set()
    for end, (n, ids) in hits:
        last = int(np.searchsorted(line, end))
        delta[last - n] += 1
        delta[last] -= 1
        items.update(ids)
    inside = np.concatenate([[False], np.cumsum(delta[:-1]) > 0, [False]])
    runs = np.flatnonzero(inside[1:] != inside[:-1])
    at = [int(starts[r]) if k % 2 == 0 else int(ends[r - 1]) for k, r in enumerate(runs)]
    return len(words), runs.tolist(), sorted(items), char_offsets(text, at)


def united(a: list[int], b: list[int]) -> list[int]:
    """Flat [start, end) intervals of both, in order, those that touch or overlap joined."""
    out: list[int] = []
    for x, y in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def _scanner(held, carried: bool):
    """A UDF from texts, and what earlier blocks found, to hits."""
    arrow = to_arrow_type(_HITS)

    def found(texts: pa.Array, before: pa.Array | None, machine) -> pa.Array:
        rows = [scan(t, machine) for t in texts.to_pylist()]
        if before is not None:
            rows = [(n, united(runs, b["runs"]), sorted({*items, *b["items"]}), united(spans, b["spans"])) if b["items"] else (n, runs, items, spans) for (n, runs, items, spans), b in zip(rows, before.to_pylist())]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow], fields=list(arrow))

    def of_block(batch: pa.RecordBatch, machine) -> pa.Array:
        return pa.concat_arrays([found(b.column(0), b.column(1) if carried else None, machine) for b in blocks(batch, 0)] or [pa.array([], arrow)])

    @F.arrow_udf(_HITS)
    @lean
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(held.value)
        for texts in batches:
            yield of_block(pa.RecordBatch.from_arrays([texts], names=["t"]), machine)

    @F.arrow_udf(_HITS)
    @lean
    def later(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = automaton(held.value)
        for texts, before in batches:
            yield of_block(pa.RecordBatch.from_arrays([texts, before], names=["t", "b"]), machine)

    return later if carried else first


def with_hits(docs: DataFrame, benchmark: DataFrame, width: int = 13, block: int = BLOCK) -> DataFrame:
    """(row, hits): each row of ``docs`` as a struct, and what was found in its text."""
    windows = written(window_table(benchmark, width), "windows")
    chars = windows.agg(F.sum(F.length("key") + F.length(F.concat_ws(" ", "items")))).head()[0] or 0
    n_blocks = max(1, -(-int(chars) // block))
    rows = docs.select(F.struct("*").alias("row"))
    for b in range(n_blocks):
        own = windows.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b)
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about `block` characters
        text = F.col("row.text").cast("string")
        rows = (written(rows, "scanned") if b else rows).select("row", (_scanner(held, True)(text, F.col("hits")) if b else _scanner(held, False)(text)).alias("hits"))
    return rows


def _judged(rows: DataFrame) -> DataFrame:
    # runs is [s0, e0, s1, e1, ...]: the words hit are the sum of ends less the sum of starts
    n_hit = F.expr("cast(aggregate(transform(hits.runs, (x, i) -> if(i % 2 = 0, -x, x)), 0, (a, x) -> a + x) as long)")
    return rows.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("hits.n_words")))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 13, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, word runs, items and spans found.

    Null or empty document text: no words, no hits. Items without words have no window. Empty benchmark: no
    hits. Repeated document rows: one result each, null doc_ids too. Extra columns are ignored. Very long texts are
    scanned whole, one at a time. All items that share a window must fit a task.
    """
    return with_hits(docs, benchmark, width, block).select(F.col("row.doc_id").cast("long").alias("doc_id"), "hits.*")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, block: int = BLOCK) -> DataFrame:
    """Counts and verdict for every document: contaminated if at least a twentieth of its words are hit. Odd rows as in ``benchmark_hits``."""
    rows = _judged(with_hits(docs, benchmark, width, block))
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "hits.n_words", "n_hit", F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "hits.spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged, each row judged by its own text.

    Null and empty texts stay, as nothing is found in them. Rows with equal or null doc_ids fare each on its
    own, equal texts alike. Empty table: no rows.
    """
    return _judged(with_hits(docs, benchmark, width, block)).where("not contaminated").select("row.*")
