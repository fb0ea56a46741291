"""Keyed tables: only touched buckets change, a repeated batch changes nothing, deletes and odd keys."""

import os

import pytest
from pyspark.sql import functions as F

from siftmill.sources.keyed_table import KeyedTable

SCHEMA = "k string, v int, at int"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def held(table):
    return sorted(((r["k"], r["v"]) for r in table.read().collect()), key=str)


def test_upserts_and_deletes_touch_their_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=8)
    assert held(table) == []
    rows = [(f"k{i}", i, 1) for i in range(40)] + [(None, 7, 1), ("", 8, 1), ("k3", 99, 0)]
    assert len(table.upsert(spark.createDataFrame(rows, SCHEMA), ["at", "v"], 0)) > 5
    want = {k: v for k, v, at in rows if at}
    assert held(table) == sorted(want.items(), key=str)
    before, names = files(tmp_path / "t"), table.version()["buckets"]
    one = spark.createDataFrame([("k5", 50, 2), ("k5", 51, 2), ("k6", 0, 0)], SCHEMA)
    assert table.upsert(one.where("k = 'k5'"), ["at", "v"], 1) and held(table) == sorted((want | {"k5": 51}).items(), key=str)
    after = files(tmp_path / "t")
    assert before.items() <= after.items() and len(after) == len(before) + 1  # one bucket's file is new, no other was touched
    assert sum(names[b] != d for b, d in table.version()["buckets"].items()) == 1
    assert table.upsert(one, ["at", "v"], 1) == [] and files(tmp_path / "t") == after  # the batch again
    table.upsert(one, ["at", "v"], 2)  # an older row does not win
    assert held(table) == sorted((want | {"k5": 51}).items(), key=str)
    assert table.delete(F.col("k").startswith("k1")) == 11
    assert held(table) == sorted(((k, v) for k, v in (want | {"k5": 51}).items() if not (k or "").startswith("k1")), key=str)
    with pytest.raises(KeyError):
        table.delete(F.col("k") == "k1")
    now = held(table)
    table.clean()
    assert held(table) == now and len(os.listdir(tmp_path / "t" / "versions")) <= 2
    assert table.delete(F.lit(True)) == len(now) and held(table) == []
