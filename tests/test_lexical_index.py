import random

from siftmill.operators import lexical_index as L
from siftmill.operators import ranking as R


def plain(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score").collect())


def test_same_rows_as_the_scan_and_ranges_are_skipped(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rare = lambda: words[min(399, int(rng.expovariate(0.02)))]
    rows = [(i, " ".join(["common", *(rare() for _ in range(rng.randint(0, 40)))])) for i in range(3000)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "Common COMMON common"), (5004, "W1 " * 5000), (5005, rows[7][1]), (5006, rows[7][1]), (5006, rows[7][1]), (7, "w399 twice")]
    corpus = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(1, "common w399 w2"), (2, "w350"), (3, "nothing here"), (4, None), (5, rows[7][1]), (6, "common common"), (7, ""), (8, "w380 w381 common w1")], "query_id long, text string")
    L.build_index(corpus, f"file://{tmp_path}/index", docs=16)
    index = L.Index(spark, f"file://{tmp_path}/index")
    for n in (1, 5, 40):
        assert plain(index.search(queries, n)) == plain(R.bm25(corpus, queries, n))
    effort = {r["query_id"]: (r["matched"], r["read"]) for r in index.effort(queries, 3).collect()}
    assert all(read <= matched for matched, read in effort.values()) and effort[8][1] < effort[8][0] // 2


def test_empty_corpus(spark, tmp_path):
    corpus = spark.createDataFrame([], "id long, text string")
    L.build_index(corpus, f"file://{tmp_path}/empty")
    assert L.Index(spark, f"file://{tmp_path}/empty").search(spark.createDataFrame([(1, "a b")], "query_id long, text string"), 3).collect() == []
