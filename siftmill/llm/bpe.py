"""Whole-text byte-level BPE with the tokenizers library, each recurring segment encoded twice per worker.

The pre-tokeniser never joins text across a single space or newline that stands between two other
characters, nor a full stop or comma that stands alone between letters or digits and what follows.
Texts are cut there, segments are looked up, and only unseen ones go to the library. A segment is kept from
its second block on, as most segments of a corpus stand in it once; what is kept is bounded. Texts in which a
cut could change the result are cut at plain spaces only, and those that name a special token are
encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Where cutting before space, newline, full stop or comma could change pre-tokens.
_RISKY = re.compile(r"\s\s|[^\w\s][.,]|_[.,]|[.,][^\w\s]|[.,]_|\s[.,]|^[\s.,]|\s$|\x01")
#: Segments that may stand in such a place; the text around them decides.
_LOOSE = re.compile(r"\s\s|^[.,]?$|^[^\S\n]|^[.,](?:[^\w\s]|_)|^.*(?:[^\w]|_)$", re.S)
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Byte-level vocabularies write each byte as a visible character: itself if printable, else the next from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LOADED: dict[str, "CachedEncoder"] = {}


class CachedEncoder:
    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.cache, self.loose, self.once = keep, {}, {}, bytearray(1 << 22)

    @classmethod
    def load(cls, path: str) -> "CachedEncoder":
        """One encoder per worker process and file."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _cut(self, text: str) -> list[str]:
        cut = text.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")
        cut[0] = "\x01" + cut[0]
        return cut

    @staticmethod
    def _cut_plainly(text: str) -> list[str]:
        first, *rest = _PLAIN_SPACE.split(text)
        return ["\x01" + first, *(s if s[:1] not in "\n.," else "\x01 " + s for s in rest)]

    @staticmethod
    def _text_of(key: str) -> str:
        if key[:1] == "\x01":
            return key[1:]
        return key if key[:1] in ("\n", ".", ",") else " " + key

    def _add(self, keys: set[str]) -> None:
        """Encodes unseen segments: those of letters only are one pre-token, so they go to the merges directly."""
        new, model, kind = keys.difference(self.cache), self.tokenizer.model, self.dtype.char
        self.fresh += new
        mixed = []
        for key in new:
            if key.isalpha():
                self.cache[key] = array(kind, [t.id for t in model.tokenize((b" " + key.encode()).decode("latin-1").translate(_VISIBLE))]).tobytes()
            else:
                mixed.append(key)
        for at in range(0, len(mixed), 10_000):
            part = mixed[at : at + 10_000]
            for key, e in zip(part, self.tokenizer.encode_batch_fast([self._text_of(k) for k in part], add_special_tokens=False)):
                ids = array(kind, e.ids).tobytes()
                loose = _LOOSE.search(key[key[:1] == "\x01" :]) and key not in (".", ",")
                self.cache[key] = None if loose else ids
                if loose:
                    self.loose[key] = ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``dtype``; null gives none."""
        if len(self.cache) > self.keep:
            self.cache, self.loose, self.once = {}, {}, bytearray(len(self.once))
        self.fresh: list[str] = []
        out = self._encode(texts)
        once, places = self.once, len(self.once)
        for key in self.fresh:
            at = hash(key) % places
            if not once[at]:  # a clash only keeps a segment early
                once[at] = 1
                del self.cache[key]
                self.loose.pop(key, None)
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._cut(t) if t else [] for t in texts]
        self._add(set().union(*cut))
        get, any_of = self.cache.__getitem__, self.loose.get
        out: list[bytes] = []
        for text, segments in zip(texts, cut):
            if not text:
                out.append(b"")
                continue
            if "\x01" in text or any(s in text for s in self.special):
                out.append(self._whole(text))
                continue
            found = list(map(get, segments))
            if None in found or ".." in text or ".," in text or ",." in text or ",," in text:
                if _RISKY.search(text):
                    segments = self._cut_plainly(text)
                    self._add(set(segments))
                    found = list(map(get, segments))
                found = [any_of(s) if f is None else f for s, f in zip(segments, found)]
            out.append(b"".join(found))
        return out
