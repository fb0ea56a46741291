"""Edge rules on hand-made frames, properties of chunkers and splits, and streams against their batch form."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siftmill.functions import text as X
from siftmill.operators import chunking, dataset, filters, joins, ranking
from siftmill.sources import readers
from siftmill.streaming import jobs


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2), (2, 5, 1)], "query_id long, id long, rank int")
    got = [(r["query_id"], r["id"], r["rank"]) for r in ranking.rrf([a, b]).orderBy("query_id", "rank").collect()]
    assert got == [(1, 10, 1), (1, 12, 2), (1, 11, 3), (2, 5, 1)]
    assert ranking.rrf([a.limit(0), b.limit(0)]).count() == 0


def test_knn_edges(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0])], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in ranking.knn(corpus, asked, 9, block=1).collect()}
    assert got == {(7, 1): 1, (7, 2): 2, (7, 3): 3, (8, 1): 1, (8, 2): 2, (8, 3): 3}
    assert ranking.knn(corpus, asked, 2, threshold=0.5).count() == 1
    assert ranking.knn(corpus, asked.limit(0), 2).count() == 0
    assert corpus.select(ranking.l2_normalise(F.col("vector")).alias("v")).collect()[2]["v"] == [0.0, 0.0]


def test_lsh_recall(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = d.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = {(r["query_id"], r["id"]) for r in ranking.knn(d, q, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in ranking.lsh_neighbours(d, q, 10, 64).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_near_duplicates_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice("xyz") * 200 + "q" * rng.randint(0, 40)) for i in range(60)] + [(60, "a", "short"), (61, "a", "short"), (62, "a", None)]
    df = spark.createDataFrame(rows, "id long, kind string, text string")
    want = sorted(a for a, k, t in rows if t and len(t) > 50 and any(b < a and k == k2 and t2 and t2[:200] == t[:200] and abs(len(t) - len(t2)) < 0.05 * len(t) for b, k2, t2 in rows))
    assert sorted(r["id"] for r in joins.near_duplicates(df, "id", "text", ["kind"]).collect()) == want


def test_scripts_and_citations(spark):
    df = spark.createDataFrame([("سلام دنیا",), ("hello",), ("see [Source 0] [Source 2] [منبع ۱] [Source 4]",), (None,)], "t string")
    assert [r[0] for r in df.select(X.script_language(F.col("t"))).collect()] == ["fa", "en", "fa", "en"]
    assert df.select(X.validate_citations(F.col("t"), 3)).collect()[2][0] == "see  [Source 2] [منبع ۱] "
    assert [r[0] for r in df.select(X.word_count("t")).collect()][:3] == [2, 1, 9]


def test_degenerate(spark):
    df = spark.createDataFrame([(1, "a b c " * 10 + "."), (2, "one two"), (3, "a long enough answer with no stop mark"), (4, "A full answer stands here. It says several things.")], "id long, t string")
    assert {r["id"]: r["degenerate"] for r in filters.degenerate(df, ["id"], "t").collect()} == {1: True, 2: True, 3: True, 4: False}


def test_chunkers():
    rng = random.Random(1)
    text = " ".join(" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 60))) + "." for _ in range(80)) + " " + "long " * 700 + "."
    chunks = chunking.sentence_chunks(text, 120, 20)
    assert all(len(c.split()) <= 120 for c in chunks)
    at, words = 0, text.split()
    for c in chunks:  # every chunk is a run of the text, and together they leave nothing out
        w = c.split()
        start = next(i for i in range(at, max(-1, at - 61), -1) if words[i : i + len(w)] == w)
        at = start + len(w)
    assert at == len(words)
    assert chunking.sentence_chunks("") == chunking.fixed_chunks("") == chunking.paragraph_chunks("") == []
    assert all(50 < len(c) <= 1000 for c in chunking.fixed_chunks(text))
    assert all(len(c.replace("\n\n", "")) <= 1500 for c in chunking.paragraph_chunks(text.replace(". ", ".\n\n")) if "long long" not in c)  # separators do not count


def test_splits_are_complete(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one, two = (dataset.exact_holdout(d, "k", "s", 0.1, 20) for d in (df, df.repartition(7)))
    assert {(r["k"], r["split"]) for r in one.collect()} == {(r["k"], r["split"]) for r in two.collect()}
    assert one.where("split = 'val'").count() == 50 and one.count() == 500
    assert dataset.exact_holdout(df.limit(5), "k", "s", 0.1, 20).where("split = 'val'").count() == 5


def test_repair_and_shapes(spark):
    text = '{"a": 1}{"b": "}{"} junk {"c": {"d": "\\"}"}} {bad} {"open": '
    df = spark.createDataFrame([(text,), (None,), ("",)], "value string")
    assert sorted(r["object"] for r in readers.repaired_objects(df, "value").collect()) == ['{"a": 1}', '{"b": "}{"}', '{"c": {"d": "\\"}"}}']
    lines = ['{"question":"q1","answer":"a1"}', '{"q":"q2","a":"a2"}', '{"messages":[{"role":"user","content":"old"},{"role":"user","content":"q3"},{"role":"assistant","content":"a3"}]}', "broken"]
    got = readers.normalise_qa(spark.createDataFrame([(x,) for x in lines], "value string"), "value").collect()
    assert [(r["question"], r["answer"]) for r in got] == [("q1", "a1"), ("q2", "a2"), ("q3", "a3"), (None, None)]


def test_admission_does_not_count_rejected():
    stamps = [i * 1_000_000 for i in range(35)] + [61_500_000, 200_000_000]
    verdict, held = jobs.admit(stamps, [])
    assert verdict == [True] * 30 + [False] * 5 + [True, True] and held == [200_000_000]


@pytest.fixture
def stream(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for first, last in ((0, 9), (10, 19), (20, 31)):  # one file after the other, as the files of a stream come
        rows.where(F.dayofmonth("ts").between(first, last)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((tuple(r) for r in df.sparkSession.table(name).collect()), key=str)


def test_streams_equal_batches(stream):
    rows, live = stream
    assert _run(jobs.admission(live, 6 * 3600, 1), "adm", "append") == sorted((tuple(r) for r in jobs.admission(rows, 6 * 3600, 1).collect()), key=str)
    assert _run(jobs.windowed_latency(live, "1 day"), "lat", "complete") == sorted((tuple(r) for r in jobs.windowed_latency(rows, "1 day").collect()), key=str)
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    assert len(_run(jobs.deduplicated(live, key).select("hash"), "ded", "append")) == jobs.deduplicated(rows, key).count()


def test_upsert_versions(spark, tmp_path, stream):
    rows, live = stream
    cols = ["user_id", "event_type", "ts", "value"]
    q = live.select(*cols).writeStream.foreachBatch(jobs.upsert_into(str(tmp_path / "state"), ["user_id", "event_type"], "ts")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir())
    got = {(r["user_id"], r["event_type"]): r["value"] for r in spark.read.parquet(str(tmp_path / "state" / f"version={last}")).collect()}
    want = {(r["user_id"], r["event_type"]): r["value"] for r in jobs.latest_values(None, rows.select(*cols), ["user_id", "event_type"], "ts").collect()}
    assert got == want


def test_model_hooks_are_called_in_batches(spark):
    asked = spark.createDataFrame([(1, "ab")], "query_id long, text string")
    corpus = spark.createDataFrame([(1, "abc"), (2, "a"), (3, None), (4, "abcdef")], "id long, text string")
    ranked = spark.createDataFrame([(1, i, i) for i in (1, 2, 3, 4)], "query_id long, id long, rank int")

    def load():
        def score(questions, passages):
            assert len(questions) == len(passages) <= 2
            return [float(len(p or "")) for p in passages]

        return score

    got = ranking.rerank(ranked, asked, corpus, 3, ranking.model_scorer(load, 2)).collect()
    assert sorted((r["rank"], r["id"], r["rerank_score"]) for r in got) == [(1, 4, 6.0), (2, 1, 3.0), (3, 2, 1.0)]
    encoder = ranking.model_encoder(lambda: lambda texts: [[len(t), 4.0] for t in texts], 3)
    vectors = {r["id"]: r["vector"] for r in ranking.vectorise(corpus, "id", "text", encoder).collect()}
    assert vectors[1] == [0.6, 0.8] and vectors[3] == [0.0, 1.0] and len(vectors) == 4


def test_hashed_vectors_against_brute_force(spark, sf):
    import functools
    import math

    from pyspark.ml.feature import HashingTF

    docs = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").toDF("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, " ")], "doc_id long, text string"))
    place = functools.cache(HashingTF(numFeatures=64).indexOf)
    bags = {r["doc_id"]: [place(w) for w in (r["text"] or "").lower().split()] for r in docs.collect()}
    df = [sum(i in set(b) for b in bags.values()) for i in range(64)]
    got = {r["doc_id"]: r["vector"] for r in ranking.vectorise(docs, "doc_id", "text", dims=64).collect()}
    assert got[-1] is None and got[-2] is None and set(got) == set(bags)
    for d, bag in list(bags.items())[::7]:
        if bag:
            raw = [bag.count(i) * math.log((len(bags) + 1) / (df[i] + 1)) for i in range(64)]
            norm = math.sqrt(sum(x * x for x in raw))
            assert all(abs(a - b / norm) < 1e-9 for a, b in zip(got[d], raw))


def test_bm25_blocks_and_odd_rows(spark):
    corpus = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "a a d"), (5, "zz")], "id long, text string")
    asked = spark.createDataFrame([(1, "a d"), (2, None), (3, "nowhere"), (4, "zz a")], "query_id long, text string")
    one = sorted(map(tuple, ranking.bm25(corpus, asked, 5).collect()))
    assert one and one == sorted(map(tuple, ranking.bm25(corpus, asked, 5, block=1).collect())) == sorted(map(tuple, ranking.bm25(corpus, asked, 5, most_terms=2).collect()))
    assert {(q, i) for q, i, *_ in one} == {(1, 1), (1, 4), (4, 1), (4, 4), (4, 5)} and {r for q, *_, r in one if q == 4} == {1, 2, 3}
    assert ranking.bm25(corpus, asked.limit(0), 5).count() == 0 == ranking.bm25(corpus.limit(0), asked, 5).count()


def test_a_norm_is_computed_once_a_row(spark):
    import time

    d = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: (x + F.col("id")).cast("double")).alias("v")).cache()
    d.count()
    start = time.monotonic()
    sums = d.select(ranking.l2_normalise(F.col("v")).alias("u")).select(ranking.dot(F.col("u"), F.col("u")).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums) and time.monotonic() - start < 8  # 360 million places where each place took its own norm


def test_lsh_candidates_are_no_rows(spark):
    d = spark.createDataFrame([(i, [float((i * 7 + k * 13) % 11 - 5) for k in range(8)]) for i in range(60)], "id long, vector array<double>")
    q = d.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    found = ranking.lsh_neighbours(d, q, 3, 8, block=2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert {r["id"] for r in rows if r["rank"] == 1} >= {0} and all(r["similarity"] >= 0 for r in rows) and len(rows) == 9


def test_term_counts_leave_a_worker_by_slices():
    import pyarrow as pa

    words = pa.array([["a", "b", "a"] if i % 3 else None for i in range(1200)], pa.list_(pa.string()))
    out = list(ranking._term_counts(["a", "c"])(iter([pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), words], names=["id", "w"])])))
    assert [b.num_rows for b in out] == [500, 500, 200]
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[600] == {"id": 600, "dl": 0, "codes": [], "counts": []} and rows[601] == {"id": 601, "dl": 3, "codes": [0], "counts": [2]}


def test_letters_are_counted_as_the_pattern_keeps_them(spark):
    texts = ["abc XYZ", "", None, "دمای شیشه", "\u05ff\u0600\u06ff\u0700\u07ff", "é ñ 12.,\n\t", "😀 a😀b", "\u3042\ufffd z", "a" * 5000]
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = d.select("text", X.n_letters(F.col("text")).alias("got"), F.length(X.letters_only(F.col("text"))).cast("long").alias("want")).collect()
    assert len(rows) == len(texts) and all(r["got"] == r["want"] for r in rows), rows
    plan = filters.drop_low_letters(d, "text", F.lit(False))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan


def test_words_are_cut_once_and_without_a_lambda(spark):
    d = spark.createDataFrame([(1, " a b  a "), (2, None), (3, " ")], "id int, text string")
    cut = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in cut(ranking.vectorise(d, "id", "text", dims=16)) and "lambda" not in cut(d.select(X.tokens(F.col("text"))))
    assert [r[0] for r in d.select(X.tokens(F.col("text"))).collect()] == [["a", "b", "a"], None, []]
