"""Readers on odd files, and the queue of failed files: statuses, tries and chunks stored once."""

import pytest
import io
import json
import shutil

import numpy as np
from pyspark.sql import functions as F

from siftmill.functions import text as X
from siftmill.sources import binary as B
from siftmill.streaming import file_queue as Q


def test_readers_on_odd_files(spark, tmp_path):
    packed = io.BytesIO()
    np.savez(packed, a=np.array([[1, 2], [3, 4]], dtype="int32"), names=np.array(["b", "a", "b"]), none=np.zeros((0, 3)), objects=np.array([{}, None], dtype=object))
    files = {"x/one.npz": packed.getvalue(), "bad.npz": b"PK no archive", "blank.txt": b" ", "latin.TXT": b"caf\xe9 ok", "void.csv": b"\n", "t.csv": b"a,b\n1,\n,\n2,x y\n3,4,5\n", "j.json": b'{"b": [1, {"c": null}]}', "no_suffix": b"1"}
    for name, content in files.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    got = {r["path"].split("/in/")[1]: r for r in B.extracted(spark, str(tmp_path / "in")).collect()}
    assert set(got) == set(files)
    assert got["x/one.npz"]["text"] == "\n".join([
        "NumPy Dataset: one", "Arrays contained: a, names, none, objects", "", "Array: a", "  Shape: (2, 2)", "  Data type: int32", "  Min: 1", "  Max: 4", "  Mean: 2.5", "  Std: 1.11803", "  Sample values: [1, 2, 3, 4]", "",
        "Array: names", "  Shape: (3,)", "  Data type: <U1", "  Unique values (sample): ['a', 'b']", "", "Array: none", "  Shape: (0, 3)", "  Data type: float64", "", "Array: objects", "  Data type: object", ""])
    assert got["t.csv"]["text"] == "Dataset: t\nColumns: a, b\nTotal records: 3\n\na: 1.0\na: 2.0 | b: x y"
    assert got["latin.TXT"]["text"] == "caf ok" and got["blank.txt"]["text"] == " " and got["blank.txt"]["error"] is None
    assert got["j.json"]["text"].startswith("JSON Dataset: j\n\nb[0]: 1")
    for name in ("bad.npz", "void.csv", "no_suffix"):
        assert got[name]["error"] and got[name]["text"] is None


def test_a_json_file_s_lists_are_read_whole(spark, tmp_path):
    (tmp_path / "long.json").write_text(json.dumps({"a": list(range(1200)), "b": [[i] for i in range(501)]}))
    lines = B.extracted(spark, str(tmp_path)).head()["text"].split("\n")[2:]
    assert lines == [f"a[{i}]: {i}" for i in range(1200)] + [f"b[{i}][0]: {i}" for i in range(501)]


def test_page_lines_keep_digits_at_their_ends(spark):
    d = spark.createDataFrame([("Room 10\nLine 1 of 11\n 1212 \nPage 3\nab\n22 is two",)], "text string")
    assert d.select(X.clean_page_lines(F.col("text"))).head()[0] == "Room 10\nLine 1 of 11\n22 is two"


def test_a_file_that_fails_twice_has_three_log_rows_and_its_chunks_once(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "good.txt").write_text("one\ntwo")
    (folder / "blank.txt").write_text(" ")
    (folder / "late.csv").write_bytes(b"\n")
    chunk = lambda d: d.select("path", F.posexplode(F.split("text", "\n")).alias("chunk", "content")).where(F.trim("content") != "")
    Q.watch(spark, str(folder), store, chunk, files_a_batch=2).awaitTermination()
    assert Q.retry(spark, store, chunk, files_a_run=1) == 2
    (folder / "late.csv").write_bytes(b"a\n5\n")
    (folder / "new.txt").write_text("three")
    Q.watch(spark, str(folder), store, chunk).awaitTermination()
    assert Q.retry(spark, store, chunk, most_attempts=3) == 2
    assert Q.retry(spark, store, chunk, most_attempts=3) == 0  # late.csv is done, blank.txt has had its three
    log = sorted((r["path"].split("/")[-1], r["attempt"], r["status"], r["chunk_count"]) for r in Q.log(spark, store).collect())
    assert log == [("blank.txt", i, "failed", 0) for i in (1, 2, 3)] + [("good.txt", 1, "completed", 2), ("late.csv", 1, "failed", 0), ("late.csv", 2, "failed", 0), ("late.csv", 3, "completed", 4), ("new.txt", 1, "completed", 1)]
    held = sorted((r["path"].split("/")[-1], r["content"]) for r in Q.chunks(spark, store).collect())
    # a batch that comes again overwrites its own rows; chunks without a log row do not count
    files = spark.read.format("binaryFile").load(str(folder / "new.txt")).select("path", "content")
    run = Q.log(spark, store).where(F.col("path").endswith("new.txt")).head()["run"]
    Q.ingest(files, store, run, 9, chunk)
    shutil.copytree(f"{store}/chunks/run={run}", f"{store}/chunks/run=lost")
    assert sorted((r["path"].split("/")[-1], r["content"]) for r in Q.chunks(spark, store).collect()) == held
    assert Q.log(spark, store).count() == 8


def test_a_key_s_texts_are_not_one_task_s(spark, tmp_path):
    from siftmill import plans
    from siftmill.plans import flows

    docs = spark.createDataFrame([(i, f"text {i}", "src0", "en" if i % 10 else "de", 6) for i in range(400)], "doc_id long, text string, source string, lang string, n_chars int")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(flows, "folder", lambda t, name: f"{tmp_path}/{name}")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = {tuple(r) for r in plans.QUERIES["src_folder_routing"](spark, str(tmp_path)).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(".txt", True, 2), (".json", True, 7), (".parquet", False, 2)}
    assert len(list((tmp_path / "files" / "b" / "d" / "lang=en").glob("*.parquet"))) > 1
    assert spark.read.parquet(f"file://{tmp_path}/files/b/d").count() == spark.read.text(f"file://{tmp_path}/files/a").count() == spark.read.json(f"file://{tmp_path}/files/b/c").count() == 400


def test_a_streamed_file_is_taken_by_its_parts(spark, tmp_path):
    pages = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "even.pdf").otherwise("odd.pdf").alias("name"), F.concat(F.col("id"), F.lit(" ۱"), F.repeat(F.lit("x"), 1000)).alias("page"))
    B.write_pages(pages.union(spark.createDataFrame([("even.pdf", None), ("none.pdf", None)], "name string, page string")), f"file://{tmp_path}/in/deep")
    whole = {p.name: p.read_bytes() for p in (tmp_path / "in" / "deep").iterdir() if p.suffix == ".pdf"}
    assert {k: len(v.split(b"\f")) for k, v in whole.items()} == {"even.pdf": 3002, "odd.pdf": 3001, "none.pdf": 2}
    assert list(B.stream_pages("", io.BytesIO(whole["even.pdf"]))) == B.page_parts("", whole["even.pdf"])
    assert list(B.stream_pages("", io.BytesIO(b""))) == B.page_parts("", b"") and list(B.stream_pages("", io.BytesIO(b"\f" * 3))) == B.page_parts("", b"\f" * 3)

    def read(title, file):
        for row in B.stream_pages(title, file):
            if title == "odd" and row[1] == 2500:
                raise ValueError("late")
            yield row

    readers, store = {".pdf": B.Streamed(read)}, str(tmp_path / "out")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/in").select("path", "content")
    plan = B.file_parts(files, readers)._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan  # the scan's schema: no file is loaded
    chunk = lambda d: d.select("path", F.col("position").alias("chunk"), F.col("text").alias("content")).where(F.col("text") != "")
    Q.watch(spark, f"{tmp_path}/in", store, chunk, readers, by_part=True).awaitTermination()
    assert Q.retry(spark, store, chunk, readers, by_part=True) == 2
    log = sorted((r["path"].split("/")[-1], r["attempt"], r["status"], r["chunk_count"], r["error"]) for r in Q.log(spark, store).collect())
    assert log == [("even.pdf", 1, "completed", 3000, None)] + [("none.pdf", i, "failed", 0, "no chunks") for i in (1, 2)] + [("odd.pdf", i, "failed", 0, "ValueError: late") for i in (1, 2)]
    assert Q.chunks(spark, store).select("path", "content").distinct().count() == 3000
