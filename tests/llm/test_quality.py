import random
import re

import duckdb
from pyspark.sql import functions as F

from siftmill.llm import quality, queries

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = _WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def brute_kept(docs, labels):
    """Ids of the documents that pass, from (doc_id, text) and (doc_id, quality) rows of fewer labels than the sample's bound."""
    import math

    import zstandard

    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)
    texts = {}
    for d, t in docs:
        n, _, _, _, repeats = brute(t)
        if n >= 50 and 2 * repeats <= n:
            b = t.encode()
            starts = {*range(0, len(b) - 2047, 2048), len(b) - 2048} if len(b) >= 2048 else ()
            texts[d] = (int(math.log2(len(b))), size(b), [size(b[i : i + 2048]) for i in sorted(starts)])
    good = {d for d, q in labels if q == 1} - {d for d, q in labels if q != 1}
    seen = {}
    for d in good & set(texts):
        band, whole, parts = texts[d]
        seen.setdefault(band, []).append(whole)
        seen.setdefault("chunk", []).extend(parts)
    limits = {}
    for band, values in seen.items():
        if len(values) >= 30:
            values = sorted(values)
            lo, hi = (values[math.ceil(p * len(values)) - 1] for p in (0.005, 0.995))
            limits[band] = (lo - 0.4 * (hi - lo), hi + 0.4 * (hi - lo))
    wide = quality.Limits()
    low, high = limits.get("chunk", wide.chunk)
    inside = lambda band, v: (lambda lo, hi: lo <= v <= hi)(*(limits.get(band) or wide.of(1 << band)))
    return [d for d, (band, whole, parts) in texts.items() if inside(band, whole) and sum(not low <= p <= high for p in parts) <= 0.3 * len(parts)]


def test_base_counts(spark, sf, odd_docs, empty_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        got = {}
        for r in quality.quality_rules(docs).collect():
            got.setdefault(r["doc_id"], []).append(r)
        assert sum(map(len, got.values())) == len(texts)
        for doc, text in texts:
            want = brute(text)
            for r in got[doc]:
                assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
                assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(empty_docs).count() == 0


SYLLABLES = [a + b for a in "bcdfghlmnprst" for b in "aeiou"]
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def noise(rng, n):
    return " ".join("".join(rng.choice(SIGNS) for _ in range(6)) for _ in range(n))


def cycle(rng, n):
    """Words that differ in a number only: no run of three stands twice, and yet there is little in it."""
    stem = "".join(rng.choice(SYLLABLES) for _ in range(4))
    return " ".join(f"{stem}{i % 83}x{i}" for i in range(n))


def test_bands(spark):
    rng = random.Random(1)
    syllables = [a + b for a in "bcdfghlmnprst" for b in "aeiou"]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(900))
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(76)) for _ in range(900))
    cycle = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(12)]
    near = " ".join(w + str(i % 7) if i % 5 == 0 else w for i, w in enumerate(cycle * 80))
    docs = spark.createDataFrame([(1, prose), (2, noise), (3, near)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()} == {1: True, 2: False, 3: False}
    assert [r["doc_id"] for r in quality.keep_good(docs).collect()] == [1]


def test_fitted_limits_decide(spark):
    """Each rule alone rejects a text that passes the base rules and the other rules."""
    rng = random.Random(2)
    good = [(i, prose(rng, rng.choice([60, 120, 250, 700, 1500]))) for i in range(400)]
    docs = spark.createDataFrame(good, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)] + [(i, 0) for i in range(5)] + [(None, 1)], "doc_id long, quality int")
    limits = quality.fit_limits(docs, labels)
    assert len(limits.whole) >= 3 and all(lo < hi for lo, hi in [*limits.whole.values(), limits.chunk])
    assert quality.quality_rules(docs, limits).where("not kept").count() == 0
    odd = [(1, prose(rng, 60) + " " + cycle(rng, 110)), (2, prose(rng, 100) + " " + noise(rng, 140)), (3, prose(rng, 500) + " " + noise(rng, 285) + " " + cycle(rng, 240))]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(odd, "doc_id long, text string"), limits).collect()}
    assert not any(r["base_failed"] or r["kept"] for r in got.values())
    low, high = limits.of(len(odd[2][1].encode()))
    assert got[1]["reason"] == "repetitive" and got[2]["reason"] == "incompressible"
    assert got[3]["reason"] == "chunks" and low <= got[3]["ratio"] <= high and got[3]["odd_chunks"] > quality.MOST_ODD
    # a whole ratio decides by itself too: texts below a chunk's length have no chunks
    short = spark.createDataFrame([(1, cycle(rng, 70))], "doc_id long, text string")
    (r,) = quality.quality_rules(short, limits).collect()
    assert (r["reason"], r["odd_chunks"], r["base_failed"]) == ("repetitive", 0.0, False)
    assert quality.fit_limits(docs.limit(0), labels) == quality.Limits() == quality.fit_limits(docs, labels.limit(0))


def test_query_rejects_junk_and_keeps_clean_documents(spark):
    """sf0.01: rejected are texts full of symbols, whatever the language; of the others at most one in five hundred."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op5_quality_rules(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("not base_failed").collect()
    clean = [r for r in rows if r["n_symbols"] * 3 < r["n_words"]]
    assert sum(not r["kept"] for r in clean) * 500 <= len(clean)
    con = duckdb.connect()
    read = lambda t, c: con.execute(f"select doc_id, {c} from '/root/testdata/sf0.01/{t}.parquet'").fetchall()
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == sorted(brute_kept(read("documents", "text"), read("labels", "quality")))
    junk = [r for r in rows if r["n_symbols"] * 3 >= r["n_words"]]
    assert sum(not r["kept"] for r in junk) * 4 >= len(junk) > 0


def test_keep_good_keeps_columns(odd_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality.quality_rules(odd_docs).collect() if r["kept"])


def test_limits_come_from_every_labelled_document(spark):
    """Of 20,900 documents the 105 last by the hash of their id decide the upper end; a sample of the first 20,000 has none of them."""
    n = 20_900
    last = [r["id"] for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(105).collect()]
    kind = lambda i: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(55)), lambda k: F.concat(F.lit("w"), F.when(F.lit(i), F.substring(F.md5(k.cast("string")), 1, 5)).otherwise(F.lpad(k.cast("string"), 5, "0")))), " ")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(last), kind(True)).otherwise(kind(False)).alias("text"))
    limits = quality.fit_limits(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    texts = {r["text"].encode() for r in docs.select("text").distinct().collect()}
    import zstandard

    low, high = sorted(len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b) for b in texts)
    assert limits.whole == {8: (low - 0.4 * (high - low), high + 0.4 * (high - low))}  # the 105 are one more than the 0.5 % of 20,900
