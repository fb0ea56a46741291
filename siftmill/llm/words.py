"""Words between ASCII separators, with offsets into the original text. Translation keeps every byte's place."""

from __future__ import annotations

import numpy as np

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z to a-z, every other ASCII byte but digits and letters to a space; bytes of longer characters stay.
ALNUM = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def alnum_words(text: str | None) -> tuple[bytes, list[bytes]]:
    """(translated bytes, words)"""
    data = (text or "").encode("utf-8", "surrogatepass").translate(ALNUM)
    return data, data.split()


def spaced(words: list[bytes]) -> str:
    """One space before, between and after the words, a character per byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of translated bytes."""
    inside = np.concatenate([[False], np.frombuffer(data, np.uint8) != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def char_offsets(text: str, at: list[int]) -> list[int]:
    """Byte offsets as code point offsets."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [int(before[i]) for i in at]
