from pyspark.sql import functions as F

from siftmill.streaming import jobs


def run(spark, folder, rows, **conf):
    rows.write.mode("append").parquet(f"{folder}/in")
    found = jobs.admission(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), **conf)
    query = found.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def stamped(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, s double").select("user_id", "event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"))


def test_stream_judges_as_the_batch_and_idle_users_leave_the_store(spark, tmp_path):
    folder = f"file://{tmp_path}"
    burst = [(u, 100 * u + i, i * 1.5) for u in range(20) for i in range(35)]  # 35 within 52.5 s: 30 admitted, 5 rejected
    held = run(spark, folder, stamped(spark, burst))
    assert max(held) >= 20  # a list for each user
    again = [(u, 100 * u + 50 + i, 61.0 + i) for u in range(3) for i in range(4)]  # only what is younger than 60 s counts; rejected ones do not
    run(spark, folder, stamped(spark, again))
    after = run(spark, folder, stamped(spark, [(99, 9999, 5000.0)]))
    assert after[-1] <= 2  # of 21 users, those who are live
    late = run(spark, folder, stamped(spark, [(0, 10_000, 6000.0)]))
    assert late[-1] <= 2
    every = stamped(spark, burst + again + [(99, 9999, 5000.0), (0, 10_000, 6000.0)])
    plain = lambda df: sorted(tuple(r) for r in df.select("user_id", "event_id", "ts", "admitted").collect())
    got = plain(spark.read.parquet(f"{folder}/out"))
    assert got == plain(jobs.admission(every))
    assert sum(not r[3] for r in got) >= 20 * 5
