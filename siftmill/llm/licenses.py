"""License scan: exact phrases, and fuzzy short notices by pigeonhole seeds with bounded-error verification.

A notice that may hold ``k`` edits is split into ``k + 1`` pieces; one of them must stand unchanged in any
match. One automaton finds phrases and pieces in one scan; around each piece the regex library's
bounded-error matching decides, counts the edits and gives the span. Words that tell a notice from others must
stand unchanged in it, and of matches that overlap the one with the fewest edits stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_texts
from .words import alnum_words, char_offsets, word_bounds

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, notice in lower-case words, what must stand unchanged in a match). Fixed values. Short words tell these notices apart,
#: so an edit there makes another notice; where there is no such pattern, notices of other labels are far away.
NOTICES = (
    ("mit", "released under the mit license", r" mit "),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", r" is hereby granted "),
    ("apache", "licensed under the apache license version 2 0", r" licen[sc]ed under "),
    ("gpl", "licensed under the gnu general public license version", r" general "),
    ("lgpl", "licensed under the gnu lesser general public license version", r" lesser "),
    ("agpl", "licensed under the gnu affero general public license version", r" affero "),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general", r" is free software .* gnu general "),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", r" are permitted "),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", r" is hereby granted "),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", r" is subject "),
    ("boost", "distributed under the boost software license version 1 0", r" distributed under "),
    ("epl", "made available under the terms of the eclipse public license", r" available under "),
    ("unlicense", "this is free and unencumbered software released into the public domain", r" is free and unencumbered "),
    ("cc0", "dedicated to the public domain under cc0 1 0", r" cc0 "),
    ("cc-by", "licensed under cc by 4 0", r" cc by (?!nc |sa |nd )"),
    ("cc-by-sa", "licensed under cc by sa 4 0", r" cc by sa "),
    ("cc-by-nd", "licensed under cc by nd 4 0", r" cc by nd "),
    ("cc-by-nc", "licensed under cc by nc 4 0", r" cc by nc (?!sa |nd )"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", r" cc by nc sa "),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", r" cc by nc nd "),
    ("agpl", "licensed under the gnu affero public license", r" affero public "),
    ("mpl", "mozilla public license version 2 0", r" mozilla public license "),
    ("bsd", "bsd 3 clause license", r" bsd [0-9] clause "),
    ("cc-by", "creative commons attribution 4 0", r" commons attribution [0-9]"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0", r" commons attribution sharealike "),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0", r" commons attribution noderivatives "),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0", r" attribution noncommercial [0-9]"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0", r" noncommercial sharealike "),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0", r" noncommercial noderivatives "),
    ("mit", "spdx license identifier mit", r" identifier mit "),
    ("apache", "spdx license identifier apache 2 0", r" identifier apache "),
    ("gpl", "spdx license identifier gpl", r" identifier gpl "),
    ("lgpl", "spdx license identifier lgpl", r" identifier lgpl "),
    ("agpl", "spdx license identifier agpl", r" identifier agpl "),
    ("bsd", "spdx license identifier bsd", r" identifier bsd "),
    ("isc", "spdx license identifier isc", r" identifier isc "),
    ("mpl", "spdx license identifier mpl 2 0", r" identifier mpl "),
)
#: A notice right behind one of these says the opposite; fixed values.
NEGATIONS = (" not ", " never ", " not", " never")
_L, _S = T.LongType(), T.StringType()
_SPANS = T.ArrayType(T.StructType([T.StructField("label", _S), T.StructField("start", _L), T.StructField("end", _L), T.StructField("edits", _L)]))
SCHEMA = T.StructType([T.StructField("doc_id", _L), T.StructField("n_words", _L), T.StructField("n_base", _L), T.StructField("first_word", _L), T.StructField("last_word", _L), T.StructField("base_labels", _S), T.StructField("labels", _S), T.StructField("score", T.DoubleType()), T.StructField("spans", _SPANS)])


def edits_allowed(notice: str) -> int:
    return max(1, min(6, len(notice) // 12))


class NoticeScanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: tuple[tuple[str, str, str], ...] = NOTICES):
        import ahocorasick
        import regex

        self.notices = [(label, notice, k := edits_allowed(notice), regex.compile(f"(?e)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}"), regex.compile(own)) for label, notice, own in notices]
        found: dict[str, list[tuple]] = {}
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append(("phrase", label, len(phrase.split())))
        for n, (_, notice, k, *_) in enumerate(self.notices):
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                found.setdefault(notice[a:b], []).append(("seed", n, a))
        self.machine = ahocorasick.Automaton()
        for key, uses in found.items():
            self.machine.add_word(key, (len(key), uses))
        self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple:
        data, words = alnum_words(text)
        line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        base, windows, whole = [], {}, set()
        for end, (length, uses) in self.machine.iter(line):
            start = end - length + 1
            for kind, of, x in uses:
                if kind == "phrase":
                    base.append((start, of))
                else:
                    _, notice, k, *_ = self.notices[of]
                    if line.startswith(notice, start - x) and start >= x:  # unchanged: no search is needed
                        whole.add((start - x, of))
                        continue
                    windows.setdefault(of, []).append((max(0, start - x - k), start - x + len(notice) + 2 * k))
        found = []

        def add(n: int, a: int, b: int, edits: int) -> None:
            label, notice, _, _, own = self.notices[n]
            kept = own.search(line, max(0, a - 1), b + 8)  # what may not follow can stand behind the match
            if kept and kept.end() <= b + 1 and not line.endswith(NEGATIONS, max(0, a - 8), a):
                found.append((edits, -len(notice), a, b, label))

        for a, n in whole:
            add(n, a, a + len(self.notices[n][1]), 0)
        for n, places in windows.items():
            _, _, _, pattern, own = self.notices[n]
            for a, b in merged(places):
                if own.search(line, max(0, a - 1), b + 8):
                    for m in pattern.finditer(line, a, b):
                        add(n, *m.span(), sum(m.fuzzy_counts))
        spans, score, taken = [], 1.0 if base else 0.0, bytearray(len(line) if found else 0)
        for edits, size, a, b, label in sorted(found):
            if taken.find(1, a, b) < 0:
                taken[a:b] = bytes([1]) * (b - a)
                spans.append((label, a, b, edits))
                score = max(score, 1 + edits / size)
        if spans:
            spans = self._original(text, data, line, spaces, spans)
        base_labels = {x for _, x in base}
        first, last = (int(np.searchsorted(spaces, base[i][0])) for i in (0, -1)) if base else (None, None)
        return len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {s["label"] for s in spans})), score, spans

    @staticmethod
    def _original(text: str, data: bytes, line: str, spaces: np.ndarray, spans: list[tuple]) -> list[dict]:
        """Places in the spaced words as code points of the text: from the first touched word to the last."""
        starts, ends = word_bounds(data)
        spans = sorted(spans, key=lambda s: (s[1], s[2], s[0]))
        bare = [(a + len(body) - len(body.lstrip()), a + len(body.rstrip())) for _, a, b, _ in spans for body in (line[a:b],)]
        words = np.searchsorted(spaces, np.array(bare) + [1, 0]) - 1  # spaces up to the first character, and before the end
        places = np.stack([starts[np.clip(words[:, 0], 0, len(starts) - 1)], ends[np.clip(words[:, 1], 0, len(ends) - 1)]], axis=1)
        offsets = np.reshape(char_offsets(text, places.ravel().tolist()), (-1, 2)).tolist()
        return [{"label": label, "start": i, "end": j, "edits": edits} for (label, _, _, edits), (i, j) in zip(spans, offsets)]


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: tuple[tuple[str, str, str], ...] = NOTICES) -> DataFrame:
    """Phrase places, labels, score and the spans of notices for every row.

    Null and empty text: no words, nothing found, places null, labels empty, score 0. Repeated rows: one result
    each. Null doc_id is kept. Extra columns are ignored. Empty table: no rows. Very long texts are scanned whole,
    one at a time; notices that overlap no other are all reported.
    """
    return map_texts(docs, "doc_id", "text", SCHEMA, lambda: NoticeScanner(phrases, notices).scan)
