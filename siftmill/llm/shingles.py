"""Word and word-run hashes of whole blocks of texts at once, by array arithmetic over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of ``x`` reaches every bit of the result."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b & (1 << 64) - 1, dtype=U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets into them; null is empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, slice_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, hashes of the words with A-Z folded, n+1 places of each text's first word)

    A word's hash does not depend on its place, so the sums are taken over slices of whole words: eight bytes
    for each byte of text are held for a slice only, however long the text.
    """
    inside = ~WHITE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes, i = np.zeros(len(starts), U), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + slice_bytes, "right")))
        part = data[a : ends[j - 1]]
        power, inverse = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum((FOLD[part].astype(U) + U(1)) * power[: len(part)], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place of the first word, hash) of every run of ``width`` words; a shorter text that has words is one run."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes))
    whole = place + width <= first[1:][text]
    at, owner = place[whole], text[whole]
    acc = np.full(len(at), width, U)
    for j in range(width):
        acc = mix(acc * U(0x2545F4914F6CDD1D) + hashes[at + j])
    parts = [(owner, at, acc)]
    for m in range(1, width):
        owner = np.flatnonzero(n == m)
        if len(owner):
            acc = np.full(len(owner), m, U)
            for j in range(m):
                acc = mix(acc * U(0x2545F4914F6CDD1D) + hashes[first[owner] + j])
            parts.append((owner, first[owner], acc))
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, sorted by both."""
    data, offsets = text_bytes(column)
    _, _, hashes, first = words(data, offsets)
    owner, _, runs = shingles(hashes, first, width)
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], runs[new]


def groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows hold ``sizes`` consecutive rows of the 2-d byte array ``values``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
