import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from siftmill.llm import merkle, ordering


def digest(text):
    return sha256(text.encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return digest("".join(map(coded, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, at):
    """For each level the digests left and right of the way."""
    out = []
    for row in tree[:-1]:
        mates = [i for i in range(at // 2 * 2, min(at // 2 * 2 + 2, len(row)))]
        out.append(([row[i] for i in mates if i < at], [row[i] for i in mates if i > at]))
        at //= 2
    return out


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf(r)) if r["doc_id"] is not None else (False, 0, leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf(r) for r in groups[x]]) for x in names}
    top = levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, r in enumerate(groups[x]):
            steps = way(trees[x], i) + way(top, k)
            at = leaf(r, 1) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else leaf(r)
            for left, right in steps:
                at = digest("".join([*left, at, *right]))
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], top[-1][0], digest("".join(d for pair in steps for part in pair for d in part)), at, at == top[-1][0]))
    return sorted(out, key=str)


def found(df, bits=merkle.BITS):
    return sorted((tuple(r) for r in merkle.dataset_manifest(df, bits).drop("pos", "steps").collect()), key=str)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = found(docs)
    assert got == brute([r.asDict() for r in docs.collect()])
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("bits", [1, 2, 9])
def test_odd_rows_at_any_part_size(spark, odd_docs, bits):
    """Nulls in every column, repeated rows, ties of doc_id, lone leaves, very long texts and clashing columns; parts of two leaves need many rounds."""
    extra = spark.createDataFrame(
        [(7, None, None, None, None), (7, "x", None, "s", 1), (14, "t", "zz", None, None), (14, "t", "é", "s", 1), (21, "w " * 200_000, "en", "s", 1), (21, "w " * 200_000, "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    rows = odd_docs.unionByName(extra, allowMissingColumns=True).withColumns({"tree": F.lit(1), "pos": F.lit("x"), "leaf": F.lit(None), "digest": F.lit(2), "_part": F.lit(3)})
    assert found(rows, bits) == brute([r.asDict() for r in rows.collect()])


def test_empty_and_lone(spark, odd_docs, empty_docs):
    assert found(empty_docs) == []
    one = odd_docs.where("doc_id = 5").limit(1)
    assert found(one) == brute([r.asDict() for r in one.collect()])
    assert merkle.Manifest(one.withColumn("leaf", F.lit("ab")), "doc_id", "lang").root == "ab"


def test_missing_nodes_are_the_fewest_and_enough():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 70)
        tree = levels([digest(str(i)) for i in range(n)])
        places = sorted(rng.sample(range(n), rng.randint(1, n)))
        asked = merkle.missing_nodes(places, n)
        reached = {(level, p >> level) for p in places for level in range(len(tree))}
        want = {(level, i ^ 1) for level, i in reached if level < len(tree) - 1 and i ^ 1 < len(tree[level]) and (level, i ^ 1) not in reached}
        assert sorted(asked) == sorted(want)
        known = {(0, p): tree[0][p] for p in places} | {(level, i): tree[level][i] for level, i in asked}
        for level in range(len(tree) - 1):
            for at in {i >> 1 for lv, i in list(known) if lv == level}:
                known[level + 1, at] = digest(known[level, 2 * at] + known.get((level, 2 * at + 1), ""))
        assert known[len(tree) - 1, 0] == tree[-1][0]


def test_proofs_of_some_leaves(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", merkle.leaf_digest("text").alias("leaf"))
    manifest = merkle.Manifest(docs, "doc_id", "lang")
    some = manifest.proofs(manifest.leaves.where("id % 17 = 3")).collect()
    assert len(some) == docs.where("doc_id % 17 = 3").count()
    assert all(merkle.fold(r["leaf"], r["steps"], r["proof"]) == manifest.root == r["folded"] for r in some)
    assert not any(merkle.fold("0" * 64, r["steps"], r["proof"]) == manifest.root for r in some)


def test_numbered_spreads_one_group_with_equal_rows(spark):
    rows = spark.range(5000).select(F.lit("g").alias("group"), F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("key"))
    got = ordering.numbered(rows, "group", ["key"], "test").collect()
    assert sorted(r["pos"] for r in got) == list(range(5000)) and {r["n"] for r in got} == {5000}
    assert [r["key"] for r in sorted(got, key=lambda r: r["pos"])] == sorted(r["key"] for r in got)
