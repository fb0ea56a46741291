"""Token counts with the whole-token shortcut for a sentencepiece BPE model.

Normalised text is one word mark, then the text with each space as a word mark. No piece has a mark
after another character, so merges never cross the place before a run of marks, and a text's count is
the sum over its pre-tokens. Offline it is proved which vocabulary strings encode alone as one token;
pre-tokens equal to one of them count 1 at once, and only the others go through the merges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_texts

_MARK = "▁"
_RUNS = re.compile(" +[^ ]*")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def whole_tokens(processor) -> set[str]:
    """Vocabulary strings, without their mark, that are proved to encode alone as one token of their own."""
    ids = [i for i in range(processor.get_piece_size()) if processor.id_to_piece(i)[:1] == _MARK and _MARK not in processor.id_to_piece(i)[1:]]
    strings = [processor.id_to_piece(i)[1:] for i in ids]
    return {s for s, i, found in zip(strings, ids, processor.encode(strings, num_threads=1)) if s and found == [i]}


class PretokenCounter:
    """Counts tokens of whole texts; keeps counts of at most ``keep`` merged pre-tokens."""

    def __init__(self, model: str, keep: int = 500_000):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.normal = [self.processor.normalize(s) for s in (" a  b\t ﬁ ", "①x", "")] == [f"{_MARK}{_MARK}a{_MARK}{_MARK}b\t ﬁ{_MARK}", f"{_MARK}①x", ""]
        #: Shortcut and cuts hold only if marks start pieces and normalisation is the identity.
        self.cuttable = self.normal and not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.no_newline = not any("\n" in p for p in pieces)
        self.known = dict.fromkeys(whole_tokens(self.processor), 1) if self.cuttable else {}
        if self.cuttable:
            self.known[""] = len(self.processor.encode(" x")) - len(self.processor.encode("x")) if _MARK in pieces else 3  # a mark alone
        self.counts, self.keep = dict(self.known), keep

    def _merge(self, new: list[str]) -> None:
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for s, ids in zip(part, self.processor.encode(part, num_threads=1)):
                # a leading newline stands behind the previous character, so the mark before it is not there
                self.counts[s] = len(ids) - (s[:1] == "\n")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuttable:
            return len(self.processor.encode(text))
        text = text.replace(_MARK, " ")
        if "  " in text or text[0] in " \n" or text[-1] == " " or " \n" in text or not self.no_newline:
            # a run of n marks and what follows is the encoding of n-1 spaces and the rest
            pretokens = [m[1:] for m in _RUNS.findall(" " + text)]
            if any(p[:1] == "\n" for p in pretokens):  # here a mark does stand before the newline
                return len(self.processor.encode(text))
        else:
            pretokens = text.replace("\n", " \n").split(" ")
        get = self.counts.get
        found = list(map(get, pretokens))
        if None in found:
            if len(self.counts) > self.keep:
                self.counts = dict(self.known)
            self._merge(list({p for p, n in zip(pretokens, found) if n is None} | {p for p in pretokens if p not in self.counts}))
            found = map(self.counts.__getitem__, pretokens)
        return sum(found)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Bytes, tokens and whether over ``limit``, for every row.

    Null and empty text: 0 bytes and 0 tokens. Repeated rows: one result each. Null doc_id is kept.
    Special strings inside a text are ordinary text. Extra columns are ignored. Empty table: no rows. Very long
    texts are counted whole, one at a time.
    """

    def make():
        counter = PretokenCounter(model)

        def of(text):
            n = counter.count(text)
            return len(text.encode()) if text else 0, n, n > limit

        return of

    return map_texts(docs, "doc_id", "text", SCHEMA, make)
