"""Queries whose SQL fixes an exact result, on hand-made tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftmill import plans
from siftmill.operators import dataset
from siftmill.operators import quantiles as Q


def ask(spark, tmp_path, name, **tables):
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return plans.QUERIES[name](spark, str(tmp_path)).collect()


def test_a_title_keeps_digits_at_its_ends(spark, tmp_path):
    rows = spark.createDataFrame([(1, "  0 a title that ends in 10 \n1 the second line 1", "en")], "doc_id long, text string, lang string")
    assert ask(spark, tmp_path, "doc_metadata", documents=rows)[0]["title"] == "0 a title that ends in 10"


def test_a_title_may_stand_after_many_short_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "short\n" * 40 + "the title is in line 41\n" + "x" * 300, "en")], "doc_id long, text string, lang string")
    assert ask(spark, tmp_path, "doc_metadata", documents=rows)[0]["title"] == "the title is in line 41"


def test_a_share_is_rounded_half_up(spark):
    val = lambda n: dataset.exact_holdout(spark.range(n), "id", "c", 0.02, 1).where("split = 'val'").count()
    assert [val(n) for n in (74, 75, 100, 124, 125)] == [1, 2, 2, 2, 3]


def test_active_users_are_counted_exactly(spark, tmp_path):
    events = spark.range(60_000).select((F.col("id") % 20_011).alias("user_id"), F.timestamp_seconds(F.lit(1_700_006_400) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    got = {r["days"]: (r["users"], r["events"]) for r in ask(spark, tmp_path, "active_users_parts", events=events)}
    last = events.agg(F.max("ts")).head()[0]
    for d in (7, 30):
        kept = events.where(F.datediff(F.lit(last), "ts") < d)
        assert got[d] == (kept.select("user_id").distinct().count(), kept.count())
    assert sorted(ask(spark, tmp_path, "active_users_parts", events=events.limit(0))) == [(7, 0, 0), (30, 0, 0)]


def rank(values, q):
    return sorted(values)[-(-len(values) * q // 100) - 1]


def test_quantiles_of_odd_groups(spark):
    rows = {"a": [5.0], "b": [float("inf"), 1.0, -2.0], "c": [7.0] * 9 + [1.0], None: [0.5, 0.25, 0.75, 1e12], "d": [float(i * i) for i in range(1000)]}
    counts = spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs] + [("a", None)], "k string, value double").groupBy("k", "value").count().withColumnRenamed("count", "n")
    for odd in (True, False):  # with an infinite value there is one bucket
        d = counts if odd else counts.where("k <=> NULL OR k <> 'b'")
        got = {r["k"]: (r["x"], r["y"]) for r in Q.exact_quantiles(d, ["k"], {"x": 0.5, "y": 0.95}).collect()}
        assert got == {k: (rank(v, 50), rank(v, 95)) for k, v in rows.items() if odd or k != "b"}
    assert Q.exact_quantiles(counts.limit(0), [], {"x": 0.5}).where("x is not null").count() == 0


@pytest.fixture(scope="module")
def many(spark):
    """30,000 events of two days, each type with more distinct values than a sketch holds."""
    n = 30_000
    return spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.timestamp_micros(F.lit(1_700_006_400_000_000) + F.col("id") * (172_800_000_000 // n)).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 4 == 0, "error").otherwise("view").alias("event_type"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 100).alias("value"))


def test_request_report_is_exact(spark, tmp_path, many):
    rows = [(r["event_type"], r["value"]) for r in many.collect()]
    for r in ask(spark, tmp_path, "request_report", events=many):
        own = [v for k, v in rows if k == r["event_type"]]
        assert [r["median"], r["p95"], r["p99"]] == [rank(own, q) for q in (50, 95, 99)]


@pytest.mark.parametrize("name", ["stream_latency", "stream_latency_parts"])
def test_sliding_windows_are_exact(spark, tmp_path, many, name):
    rows = [(r["ts"], r["value"]) for r in many.collect()]
    got = ask(spark, tmp_path, name, events=many)
    assert len(got) == 46  # two days and the 23 hours before, less the last hour and those not closed by then
    for r in got[::9]:
        own = [v for at, v in rows if 0 <= (at - r["window_start"]).total_seconds() < 86_400]
        assert (r["n"], r["p50"], r["p95"]) == (len(own), rank(own, 50), rank(own, 95))


@pytest.mark.parametrize("name", ["latency_24h", "latency_24h_parts"])
def test_the_last_day_is_exact(spark, tmp_path, many, name):
    wide = many.withColumn("value", F.col("value") * 100)
    rows = [(r["ts"], r["value"]) for r in wide.collect()]
    own = [v for at, v in rows if (max(rows)[0] - at).total_seconds() < 86_400]
    (r,) = ask(spark, tmp_path, name, events=wide)
    assert (r["n"], r["p50"], r["p95"]) == (len(own), rank(own, 50), rank(own, 95))


def test_the_quality_of_texts_without_a_word(spark, tmp_path):
    texts = ["", " \n\t ", None, "some words tion", ". ! ?", "A sentence of words. " * 8]
    got = ask(spark, tmp_path, "text_quality", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(plans.ORACLE_SQL["text_quality"]).fetchall())
