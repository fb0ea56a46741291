import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siftmill.llm import sharding


def check(rows, docs, shards=24):
    """Every row once with its size and crc32, places gapless in each shard; returns the bytes of the shards."""
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(d["doc_id"]), size(d["text"]), zlib.crc32((d["text"] or "").encode())) for d in docs)
    held, places, of = Counter(), defaultdict(list), {}
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        held[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return held


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.document_shards(docs).collect()
    held = check(rows, docs.select("doc_id", "text").collect())
    most = max(r["size"] for r in rows)
    assert len(held) == 24 and max(held.values()) - min(held.values()) <= most
    assert len({(r["virtual_slot"], r["shard"]) for r in rows}) == len({r["virtual_slot"] for r in rows})  # nothing is split


def test_odd_rows(spark, odd_docs, empty_docs):
    odd = odd_docs.withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "size": F.lit(None), "virtual_slot": F.lit(1), "piece": F.lit(2)})
    check(sharding.document_shards(odd).collect(), odd.select("doc_id", "text").collect())
    assert sharding.document_shards(empty_docs).collect() == []
    long = spark.createDataFrame([(1, "é" * 2_000_000), (2, "x")], "doc_id long, text string")
    check(sharding.document_shards(long).collect(), long.collect())


def test_one_id_with_a_third_of_all_rows_is_split(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text in every row").alias("text"))
    rows = sharding.document_shards(docs).collect()
    held = check(rows, docs.collect())
    assert len(held) == 24 and max(held.values()) <= 1.05 * min(held.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) > 5


def test_maps_are_versions_and_edits_are_small(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    plan = sharding.Sharding(docs, "doc_id", "bytes", 6)
    first = {r["doc_id"]: r["shard"] for r in plan.placed(1).collect()}
    plan.edit(7)
    assert {r["doc_id"]: r["shard"] for r in plan.placed(1).collect()} == first  # an old version stays readable
    grown = {r["doc_id"]: (r["shard"], r["bytes"]) for r in plan.placed().collect()}
    assert {s for k, (s, _) in grown.items() if s != first[k]} == {6}  # rows move into the new shard only
    held = Counter()
    for shard, size in grown.values():
        held[shard] += size
    assert max(held.values()) <= 1.2 * min(held.values())
    fewer = sharding.as_dict(plan.edit(5))
    assert set(fewer.values()) == set(range(5)) and plan.placed().count() == len(first)
    assert {r["version"] for r in plan.placed().select("version").collect()} == {3}


def test_rebalancing_ends_and_levels():
    rng = random.Random(5)
    for _ in range(100):
        loads = {(i, 0): rng.choice([0, 1, rng.randint(1, 100), rng.randint(1, 5000)]) for i in range(rng.randint(1, 300))}
        shards = rng.randint(1, 9)
        current = {s: rng.randint(0, 9) for s in loads if rng.random() < 0.9}
        after = sharding.rebalanced(current, loads, shards)
        assert set(after) == set(loads) and set(after.values()) <= set(range(shards))
        held = Counter({s: 0 for s in range(shards)})
        for slot, shard in after.items():
            held[shard] += loads[slot]
        assert max(held.values()) - min(held.values()) <= max(max(loads.values()), 0.02 * sum(loads.values()) / shards + 1)


def test_shards_as_files(spark, odd_docs, tmp_path):
    plan = sharding.write_shards(odd_docs.withColumn("shard", F.lit("clash")), f"file://{tmp_path}/shards", shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    plain = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    assert plain(back.select("row.*").drop("shard")) == plain(odd_docs)
    assert back.select("shard").distinct().count() == 3 and plan.maps.endswith("shards_map")
