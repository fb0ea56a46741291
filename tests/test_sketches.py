import random

from pyspark.sql import functions as F

from siftmill.operators import sketches as S
from siftmill.streaming import jobs


def stamped(spark, rows):
    return spark.createDataFrame(rows, "user_id long, s double, event_type string, value double").select("user_id", F.timestamp_seconds(F.lit(1_700_006_400) + F.col("s")).alias("ts"), "event_type", "value")


def test_ranks_beyond_the_sketch_size(spark):
    n = 60_000
    parts = S.latency_parts(spark.range(n).select((F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.lit(1_700_006_400) + F.col("id") % 7200).alias("ts"), F.lit("x").alias("event_type"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("value")))
    assert parts.count() == 2
    got = S.report(S.merged(parts)).head()
    assert got["n"] == n and abs(got["p50"] - n * 0.5) < 0.003 * n and abs(got["p95"] - n * 0.95) < 0.003 * n


def test_sliding_windows_from_hours_are_those_from_events(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 9), rng.random() * 200_000, rng.choice(["error", "view"]), float(rng.randint(0, 5))) for _ in range(800)]
    rows += [rows[0]] * 3
    events = stamped(spark, rows)
    plain = lambda df: sorted(map(tuple, df.select("window_start", "n", "mean", "p50", "p95", "failures").collect()))
    assert plain(S.report(S.sliding(S.latency_parts(events), F.timestamp_seconds(F.lit(4_000_000_000))), "window_start")) == plain(jobs.windowed_latency(events, "24 hours", "1 hour"))
    until = F.timestamp_seconds(F.lit(1_700_006_400 + 40 * 3600))
    assert S.sliding(S.latency_parts(events), until).agg(F.max("window_start") <= until - F.expr("INTERVAL 24 HOURS")).head()[0]


def test_last_hours_take_the_rest_of_the_first_hour(spark):
    rng = random.Random(2)
    rows = [(1, rng.random() * 300_000, "error" if i % 5 else "view", rng.random()) for i in range(3000)]
    events = stamped(spark, rows)
    got = S.report(S.last_hours(S.latency_parts(events), events), digits=9).head()
    newest = max(r[1] for r in rows)
    kept = sorted(r[3] for r in rows if r[1] > newest - 86_400)
    assert got["n"] == len(kept) and got["failures"] == sum(r[2] == "error" for r in rows if r[1] > newest - 86_400)
    assert abs(got["p50"] - kept[-(-len(kept) // 2) - 1]) < 1e-8
    assert S.last_hours(S.latency_parts(events.limit(0)), events.limit(0)).where("n > 0").count() == 0


def test_distinct_users(spark):
    events = spark.range(40_000).select((F.col("id") % 9000).alias("user_id"), F.timestamp_seconds(F.lit(1_700_006_400) + F.col("id") * 60).alias("ts"))
    exact = {d: events.where(F.datediff(F.lit(events.agg(F.max("ts")).head()[0]), "ts") < d).agg(F.count_distinct("user_id")).head()[0] for d in (7, 30)}
    got = {r["days"]: r["users"] for r in S.active_users(S.user_parts(events)).collect()}
    assert all(abs(got[d] - exact[d]) <= 0.02 * exact[d] for d in exact)
    assert S.active_users(S.user_parts(events.limit(0))).collect() == []
