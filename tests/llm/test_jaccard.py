import random
import re

import numpy as np
import pyarrow as pa

from siftmill.llm import components, jaccard, shingles

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = _WORD.findall((text or "").translate(_LOW))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, (d, s) in enumerate(sets):
        if d is None or not s:
            continue
        for j in {j for e in s for j in by.get(e, ())} | {j for j in range(i) if sets[j][0] == d}:
            both = len(s & sets[j][1])
            if 100 * both >= 75 * len(s | sets[j][1]) or sets[j][0] == d:
                parent[root(i)] = root(j)
        for e in s:
            by.setdefault(e, []).append(i)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None and s:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), None if d is None else least[root(i)] if s else d) for i, (d, s) in enumerate(sets)), key=str)


def _got(df):
    return sorted((tuple(r)[:3] for r in df.collect()), key=str)


def test_against_brute_force(spark, sf, odd_docs, empty_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert _got(jaccard.jaccard_components(docs)) == brute(rows)
    assert jaccard.jaccard_components(empty_docs).count() == 0


def test_chains_edits_and_sizes(spark):
    """Families by random edits around the threshold, of many sizes, short texts included, and a passage that many share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared, rows = [word() for _ in range(40)], []
    for n in (1, 3, 4, 5, 6, 7, 8, 9, 11, 14, 17, 20, 28, 29, 40, 52, 53, 90, 101, 160, 300):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(5):
                w = list(base)
                for _ in range(rng.randint(0, max(1, n // 18))):
                    at = rng.randrange(len(w) + 1)
                    w[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
                rows.append((len(rows), " ".join(w)))
                if rng.random() < 0.3:
                    base = w
    for n in (5, 10, 30, 80):
        for _ in range(25):
            w = [word() for _ in range(n)]
            rows.append((len(rows), " ".join(w[: n // 2] + shared + w[n // 2 :])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert _got(jaccard.jaccard_components(docs)) == want
    assert len({c for _, _, c in want}) < len(rows) - 100


def test_one_of_each(odd_docs):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    want = sorted(d for d, n, c in brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()]) if d is not None and d == c)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(want))
    assert kept.where("doc_id is null").count() == 1


def test_word_hashes_tell_words_apart():
    texts = pa.array(["The the  THE", None, "", "a\tb\x0bc é É", "thE"])
    data, offsets = shingles.text_bytes(texts)
    starts, ends, hashes, first = shingles.words(data, offsets)
    assert np.diff(first).tolist() == [3, 0, 0, 5, 1]
    assert hashes[0] == hashes[1] == hashes[2] == hashes[-1]
    assert len(set(hashes.tolist())) == 6


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 105)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_loose_family(spark):
    """Edited copies that link with few others and hardly with one centre: large buckets, decided in blocks."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for size, members in ((60, 150), (150, 120)):
        base = [word() for _ in range(size)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(1, size // 18)):
                w[rng.randrange(size)] = word()
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({c for _, _, c in want}) > 10
    assert _got(jaccard.jaccard_components(docs)) == want


def test_null_id_copy_comes_first(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(w)), (5, " ".join(w)), (3, " ".join(w[:-2] + ["other", "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert _got(jaccard.jaccard_components(docs)) == brute(rows)
