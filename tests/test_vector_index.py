import numpy as np

from siftmill.operators import ranking as R
from siftmill.operators import vector_index as V


def recall(spark, x, probes, refine, n=10):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    asked = rows.where("id % 50 = 0").selectExpr("id AS query_id", "vector")
    books = V.train(rows, lists=32)
    found = V.candidates(V.build_lists(rows, books), asked, books, probes, refine)
    best = {(r["query_id"], r["id"]) for r in V.neighbours(rows, asked, found, n).collect()}
    exact = {(r["query_id"], r["id"]) for r in R.knn(rows, asked, n).collect()}
    return len(best & exact) / len(exact), found.count() / (len(x) * asked.count())


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_clusters_need_few_lists(spark):
    rng = np.random.default_rng(1)
    x = unit(np.repeat(rng.standard_normal((40, 64)), 50, axis=0) + 0.3 * rng.standard_normal((2000, 64)))
    found, share = recall(spark, x, probes=4, refine=100)
    assert found >= 0.9 and share <= 0.1


def test_independent_vectors(spark):
    found, share = recall(spark, unit(np.random.default_rng(2).standard_normal((3000, 64))), probes=28, refine=240)
    assert found >= 0.9 and share <= 0.1


def test_odd_sizes(spark):
    x = unit(np.random.default_rng(3).standard_normal((5, 64)))
    assert recall(spark, x, probes=1, refine=50)[0] == 1.0
    rows = spark.createDataFrame([(1, x[0].tolist()), (2, None), (3, x[0].tolist())], "id long, vector array<double>")
    books = V.train(rows)
    none = rows.where("id < 0").selectExpr("id AS query_id", "vector")
    assert V.build_lists(rows, books).count() == 2 and V.candidates(V.build_lists(rows, books), none, books, 1, 5).collect() == []
