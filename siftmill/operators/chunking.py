"""Chunkers: sequential folds over one document at a time, in Arrow batches; documents are spread by Spark."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20

_STOP, _STOP_BEFORE_CAPITAL = re.compile(r"(?<=[.!?؟۔])\s+"), re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_PLAIN_STOP = re.compile(r"(?<=[.!?])\s+")


def sentences_of(text: str, language: str = "en") -> list[str]:
    """White space collapsed, cut after a stop: for ``fa`` at any space behind one, else only where a capital follows."""
    pattern = _STOP if language == "fa" else _STOP_BEFORE_CAPITAL
    return [s for s in pattern.split(" ".join(text.split())) if s]


def estimated_tokens(text: str) -> int:
    """Four characters a token, one at least; a tokenizer's own count can be given instead."""
    return max(1, -(-len(text) // 4))


def _packed(pieces: list[str], room: int, count: Callable[[str], int]) -> Iterator[list[str]]:
    """Runs of pieces that fit the room; one that is too large stands alone."""
    held, used = [], 0
    for piece in pieces:
        n = count(piece)
        if held and used + n > room:
            yield held
            held, used = [], 0
        held.append(piece)
        used += n
    if held:
        yield held


def sentence_chunks(text: str, budget: int = 512, overlap: int = 64, count: Callable[[str], int] = estimated_tokens, language: str = "en") -> list[str]:
    """Sentences packed to a token budget; a chunk starts with the last sentences of the one before that fit the overlap.

    So a chunk may pass the budget by what overlaps. A sentence over the budget closes the chunk, is packed by
    words, and nothing overlaps it.
    """
    out: list[str] = []
    held: list[tuple[str, int]] = []
    used = 0
    for sentence in sentences_of(text, language):
        n = count(sentence)
        if held and (n > budget or used + n > budget):
            out.append(" ".join(s for s, _ in held))
            room = overlap if n <= budget else -1
            keep = len(held)
            while keep and (room := room - held[keep - 1][1]) >= 0:
                keep -= 1
            held = held[keep:]
            used = sum(k for _, k in held)
        if n > budget:
            out += [" ".join(words) for words in _packed(sentence.split(), budget, count)]
        else:
            held.append((sentence, n))
            used += n
    return [*out, " ".join(s for s, _ in held)] if held else out


def fixed_chunks(text: str, size: int = 1000, overlap: int = 200, reach: int = 100, least: int = 50) -> list[str]:
    """Windows of ``size`` characters, cut back to the last full stop or newline within ``reach``; the next one starts ``overlap`` before.

    A text of at most ``size`` is one chunk as it is. Pieces of at most ``least`` characters are left out.
    """
    if len(text) <= size:
        return [text] if text else []
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            back = max(text.rfind(c, end - reach, end) for c in ".\n")
            end = back + 1 if back >= 0 else end
        piece = text[at:end].strip()
        out += [piece] if len(piece) > least else []
        at = end - overlap
    return out


def paragraph_chunks(text: str, size: int = 1500, separator: str = "\n\n") -> list[str]:
    """Paragraphs packed to ``size`` characters, separators not counted; a longer one is cut by sentences that share no chunk with others."""
    out: list[str] = []
    small: list[str] = []

    def flush() -> None:
        out.extend(separator.join(run) for run in _packed(small, size, len))
        small.clear()

    for part in filter(None, (p.strip() for p in text.split(separator))):
        if len(part) <= size:
            small.append(part)
            continue
        flush()
        out.extend(" ".join(run) for run in _packed(_PLAIN_STOP.split(part), size, len))
    flush()
    return out


def chunked(df: DataFrame, key: str, text: str, chunker: Callable[[str], list[str]], keep: Sequence[str] = ()) -> DataFrame:
    """(key, chunk, content) of every chunk, and the columns ``keep`` of its row; null and blank texts give none. A worker holds the chunks of ``BLOCK_BYTES`` of text, or of one longer text."""

    kind = {c: df.schema[c].dataType.simpleString() for c in (key, *keep)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES)))
                rows = [(k, i, c) for k, t in enumerate(batch.column(1).slice(at, end - at).to_pylist(), at) if t and t.strip() for i, c in enumerate(chunker(t))]
                row, place, content = zip(*rows) if rows else ((), (), ())
                row = pa.array(row, pa.int64())
                kept = [batch.column(i).take(row) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(place, pa.int32()), pa.array(content, pa.string()), *kept], names=[key, "chunk", "content", *keep])
                at = end
        pa.default_memory_pool().release_unused()

    return df.select(key, text, *keep).mapInArrow(run, ", ".join([f"{key} {kind[key]}, chunk int, content string", *(f"{c} {kind[c]}" for c in keep)]))
