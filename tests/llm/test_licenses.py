import random
import re

import numpy as np

from siftmill.llm import licenses

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    words = _WORD.findall((text or "").translate(_LOW))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_base(spark, sf, odd_docs, empty_docs):
    tricky = spark.createDataFrame([(800, "MIT license, mit-license! MIT\nLicense x"), (801, "the GNU General Public License and the apache license"), (802, "summit license mit licenses")], "doc_id long, text string")
    for docs in (odd_docs, tricky, spark.read.parquet(f"{sf}/documents.parquet")):
        want = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
        got = licenses.license_scan(docs).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == want
        for r in got:
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.license_scan(empty_docs).count() == 0


def test_fuzzy_notices():
    scan = licenses.NoticeScanner().scan
    edits = [("Released under the MIT Licence", "mit", 1), ("Reelased under the MIT License", "mit", 2), ("Licensed under the Apach License, Version 2.0", "apache", 1), ("licensed under CC BY-NC 4.0", "cc-by-nc", 0)]
    for text, label, n in edits:
        text = f"é lead words. {text}. More words follow here"
        *_, labels, score, spans = scan(text)
        assert label in labels.split(","), text
        s = next(s for s in spans if s["label"] == label)
        found = " ".join(_WORD.findall(text[s["start"] : s["end"]].translate(_LOW)))
        notice = min((x for y, x, _ in licenses.NOTICES if y == label), key=lambda x: distance(x, found))
        assert s["edits"] >= distance(notice, found) - 2 and s["edits"] <= licenses.edits_allowed(notice)
    assert scan("Released under the BSD terms and cc by nothing")[5] == ""
    assert scan(None) == (0, 0, None, None, "", "", 0.0, [])


def test_every_notice_gives_its_own_label_only():
    scan = licenses.NoticeScanner().scan
    for label, notice, _ in licenses.NOTICES:
        for other, second, _ in licenses.NOTICES:
            text = f"Some words, {notice}. Then more words stand between; {second}! End."
            found = [s["label"] for s in scan(text)[7]]
            assert found == [label, other], (notice, second)
    for text, labels in (("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("Licensed under CC BY-ND 4.0", "cc-by-nd"), ("Released under the wit licence", ""), ("Released under the wit license, mit", ""), ("Licensed under CC BY-NC-SA 3.0", "cc-by-nc-sa"), ("Licenced under CC BY 4.0 nc", "cc-by"), ("Licensed under CC BX-NC 4.0", "")):
        assert scan(text)[5] == labels, text


def least_distance(line, notice):
    """The smallest number of edits between the notice and any part of the line: one column of the table a character."""
    steps = np.arange(len(notice) + 1)
    codes, column, least = np.array([ord(c) for c in notice]), steps.copy(), len(notice)
    for c in line:
        change = column[:-1] + (codes != ord(c))
        new = np.concatenate([[0], np.minimum(change, column[1:] + 1)])
        column = np.minimum.accumulate(new - steps) + steps
        least = min(least, int(column[-1]))
    return least


def test_labels_by_edit_distance(spark):
    """One edited notice a text: found if and only if its edits are few enough and its own words stand, at no other place and under no other label."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        label, notice, own = licenses.NOTICES[i % len(licenses.NOTICES)]
        chars = list(notice)
        for _ in range(rng.randint(0, 1 + licenses.edits_allowed(notice))):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], [rng.choice("abcxyz0")], [chars[at], rng.choice("qwv")]])
        lead = " ".join("".join(rng.choice("eiou") + rng.choice("fjhz") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 40)))
        rows.append((i, f"{lead}. {''.join(chars)}! {lead}"))
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = 0
    for i, text in rows:
        line = f" {' '.join(_WORD.findall(text.translate(_LOW)))} "
        near = [(least_distance(line, notice), label) for label, notice, own in licenses.NOTICES if not own or re.search(own, line)]
        near = [(d, label) for d, label in near if d <= next(licenses.edits_allowed(n) for x, n, _ in licenses.NOTICES if x == label and least_distance(line, n) == d)]
        labels = {s["label"] for s in got[i]["spans"]}
        assert labels <= {x for _, x in near} and bool(labels) == bool(near), text
        if near:
            met += 1
            assert {x for _, x in near if len({y for _, y in near}) == 1} <= labels and min(near)[0] == min(s["edits"] for s in got[i]["spans"])
    assert met > 150


def test_negated_and_named_licenses():
    scan = licenses.NoticeScanner().scan
    cases = {
        "Permission is not granted free of charge to any person obtaining a copy of this software": "", "SPDX-License-Identifier: LGPL-2.1-only": "lgpl", "// SPDX-License-Identifier: MIT": "mit",
        "the Mozilla Public License, version 2.0": "mpl", "Creative Commons Attribution 4.0 International": "cc-by", "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa", "Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc",
        "Licensed under the GNU Affero Public License": "agpl", "BSD 3-Clause License": "bsd", "BSD 2-Clause license": "bsd", "not distributed under the Boost Software License, version 1.0": "",
        "redistribution and use in source and binary forms with or without modification are not permitted": "", "This source code form is not subject to the terms of the Mozilla Public License": "",
    }
    for text, label in cases.items():
        assert scan(text)[5] == label, text


def test_a_very_long_text_of_notices_takes_time_by_its_length():
    """Ten megabytes, every place found."""
    import time

    scan, text = licenses.NoticeScanner().scan, "released under the mit license, " * 320_000
    start = time.time()
    n, base, first, last, *_, spans = scan(text)
    assert (n, base, first, last, len(spans)) == (1_600_000, 320_000, 3, 1_599_998, 320_000)
    assert all(text[s["start"] : s["end"]] == "released under the mit license" and s["edits"] == 0 for s in spans[::1000])
    assert time.time() - start < 60
