import hashlib
import re

from pyspark.sql import functions as F

from siftmill.llm import decontamination

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return _WORD.findall((text or "").translate(_LOW))


def brute(text, items, width=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        n = min(width, len(q))
        for i in range(len(q) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == q[i : i + n]:
                    found.add(str(item))
                    hit.update(range(j, j + n))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def _got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_against_brute_force(spark, sf, odd_docs, empty_docs):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").limit(10)
    items = [tuple(r) for r in benchmark.collect()]
    text = items[0][1]
    extra = spark.createDataFrame([(900, "before, " + text.upper() + " after " + items[1][1]), (901, text[: len(text) // 2])], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60"))
    bench = benchmark.unionByName(spark.createDataFrame([(50, "one"), (51, None), (52, "..."), (7, "a b C d")], "item_id long, text string"))
    items = [tuple(r) for r in bench.collect()]
    want = sorted(((r["doc_id"], *brute(r["text"], items)) for r in docs.collect()), key=str)
    assert _got(decontamination.contamination(docs, bench)) == want
    assert sum(x[5] for x in want) >= 3
    assert decontamination.contamination(empty_docs, bench).count() == 0
    clean = decontamination.keep_clean(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    bad = [r for r in odd_docs.collect() if brute(r["text"], items)[4]]
    assert bad and clean.count() == odd_docs.count() - len(bad)
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_blocks_agree(spark, sf):  # the benchmark has 85,000 characters of windows
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = decontamination.contamination(docs, bench)
    rows = decontamination.benchmark_hits(docs, bench, block=20_000)
    want = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in one.collect()}
    assert {r["doc_id"]: (sum(r["runs"][1::2]) - sum(r["runs"][::2]), len(r["items"])) for r in rows.collect()} == want


def quick(items, width=13):
    """A function as ``brute``, by sets of word tuples."""
    windows = {}
    for item, t in items:
        q = words(t)
        n = min(width, len(q))
        for i in range(len(q) - n + 1 if n else 0):
            windows.setdefault(tuple(q[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}

    def of(text):
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if items := windows.get(tuple(w[j : j + n])):
                    found |= items
                    hit.update(range(j, j + n))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    return of


def test_all_documents_and_items_in_blocks_of_any_size(spark, odd_docs):
    folder = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").unionByName(spark.createDataFrame([(7, "one"), (None, "no id here"), (3, "A b, c")], "item_id long, text string"))
    null = F.lit(None).cast("long")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    docs = docs.unionByName(docs.where("doc_id % 50 = 0")).unionByName(docs.where("doc_id % 50 = 1").withColumn("doc_id", null))
    of = quick([tuple(r) for r in bench.collect()])
    want = sorted(((r["doc_id"], *of(r["text"])) for r in docs.collect()), key=str)
    assert sum(x[5] for x in want) > 20 and any(x[0] is None and x[5] for x in want)
    for block in (decontamination.BLOCK, 30_000):
        assert _got(decontamination.contamination(docs, bench, block=block)) == want
        kept = sorted(((r["doc_id"], r["text"]) for r in decontamination.keep_clean(docs, bench, block=block).collect()), key=str)
        assert kept == sorted(((r["doc_id"], r["text"]) for r in docs.collect() if not of(r["text"])[4]), key=str)


def test_spans_map_to_original(spark):
    item = "Één twee, DRIE vier vijf zes zeven acht negen tien elf twaalf dertien"
    text = "«ünder» ... " + item.replace(" ", "  ") + "!! rest"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    a, b = decontamination.contamination(docs, spark.createDataFrame([("x", item)], "item_id string, text string")).head()["spans"]
    assert text[a:b] == item.replace(" ", "  ")


def test_blocks_keep_null_and_repeated_ids_apart(spark, odd_docs):
    bench = spark.createDataFrame([(1, "no id here"), (2, "a b c d"), (3, "never anywhere"), (4, "one")], "item_id long, text string")
    docs = odd_docs.unionByName(odd_docs.where("doc_id in (4, 8, 9)").withColumn("doc_id", F.lit(None).cast("long")))
    one = decontamination.benchmark_hits(docs, bench).collect()
    assert len(one) == docs.count() and sorted(map(str, decontamination.benchmark_hits(docs, bench, block=9).collect())) == sorted(map(str, one))
    want = sorted(map(str, decontamination.keep_clean(docs, bench).collect()))
    assert len(want) < docs.count() and any(r["doc_id"] is None for r in decontamination.keep_clean(docs, bench).collect())
    assert sorted(map(str, decontamination.keep_clean(docs, bench, block=9).collect())) == want
