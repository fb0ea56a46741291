import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from siftmill.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counts(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= 2 and len(w) >= 7}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_of(words):
    """By what is left without one code point: all pairs that can be near, each then decided by ``one_edit``."""
    left = defaultdict(set)
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) < 200 else {w}:
            left[rest].add(w)
    near = defaultdict(set)
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_edit(a, b)}
    return near


def brute(docs):
    n = counts(docs)
    near, form = near_of(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=str)


def found(df):
    return sorted((tuple(r) for r in spelling.spelling_groups(df).collect()), key=str)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = found(docs)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(r[1] for r in got)


def test_odd_rows(spark, odd_docs, empty_docs):
    """Chains of forms, ties, repeated grams, accents, capitals beyond ASCII, signs within the range of letters, runs of a million letters."""
    words = ["received"] * 2000 + ["recieved"] * 3 + ["receivedd"] * 150 + ["receiveddx"] * 4 + ["aaaaaaaa"] * 30 + ["aaaaaaa"] * 3 + ["aaaaaaab"] * 30 + ["aaaaaaac"] * 2
    words += ["ÀÉÎõü×÷a"] * 3 + ["ÀÉÎõü×÷b"] * 40 + ["Straßenbahn"] * 20 + ["Strasenbahn", "STRAßenbahn"] * 2 + ["abababab"] * 2 + ["babababa"] * 2 + ["ababababa"] * 25
    rows = [(1000 + i, " ".join(words[i::50])) for i in range(50)] + [(None, "received nodocid nodocid"), (2000, "x" * 1_000_000 + " y"), (2001, "x" * 1_000_000 + "é 한국어 " + "x" * 999_999), (2002, "x" * 999_999)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({"word": F.lit(1), "n": F.lit("x"), "id": F.lit(3), "key": F.lit(None)})
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(empty_docs) == []


def test_no_near_pair_is_lost(spark):
    """Short alphabets make bigrams repeat; the signatures alone must bring every near pair together."""
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("ab" if i % 2 else "abcde") for _ in range(rng.randint(7, 12))) for i in range(3000)})
    ids = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = {(words[r["a"]], words[r["b"]]) for r in spelling.near_words(ids).collect()}
    near = near_of(words)
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in near for b in near[a]} and len(got) > 1000


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(2)
    for _ in range(500):
        order = np.array([rng.randint(0, 20) for _ in range(rng.randint(6, 12))])
        prefix = np.sort(np.argsort(order, kind="stable")[:3])
        a, b = spelling.pivots(order, prefix)
        pairs = [(int(x), int(y)) for x in prefix for y in prefix if y - x >= 2]
        assert b - a >= 2 and order[a] + order[b] == min(order[x] + order[y] for x, y in pairs)
