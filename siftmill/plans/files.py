"""Files written from the given tables, read back through the readers, and a folder ingest with a queue of failed files."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import binary as B
from ..sources import stages
from ..streaming import file_queue as Q
from .registry import Tables, query


@query("npz_summary", """WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT label, unnest(e) AS x FROM v)
SELECT 'label-' || label AS title, 'vectors' AS array, '(' || count(DISTINCT vec_id) || ', ' || max(len(e)) || ')' AS shape, 'float64' AS dtype, printf('%.6g', (SELECT min(x) FROM x WHERE x.label = v.label))::DOUBLE AS low, printf('%.6g', (SELECT max(x) FROM x WHERE x.label = v.label))::DOUBLE AS high,
printf('%.6g', (SELECT avg(x) FROM x WHERE x.label = v.label))::DOUBLE AS mean, printf('%.6g', (SELECT stddev_pop(x) FROM x WHERE x.label = v.label))::DOUBLE AS std, arg_min(e, vec_id)[1:5]::VARCHAR AS first_five FROM v GROUP BY label
UNION ALL SELECT 'label-' || label, 'ids', '(' || count(*) || ',)', 'int64', min(vec_id), max(vec_id), printf('%.6g', avg(vec_id))::DOUBLE, printf('%.6g', stddev_pop(vec_id))::DOUBLE, list(vec_id ORDER BY vec_id)[1:5]::VARCHAR FROM embeddings GROUP BY label""")
def _(t: Tables) -> DataFrame:
    """The vectors of each label as an NPZ file, read back as summaries of its arrays."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("vec_id"), io.BytesIO()
        np.savez(out, vectors=np.array(rows["embedding"].tolist(), dtype="float64"), ids=rows["vec_id"].to_numpy(dtype="int64"))
        return pd.DataFrame({"name": [f"label-{key[0]}.npz"], "content": [out.getvalue()]})

    folder = B.write_files(t.embeddings.groupBy("label").applyInPandas(packed, "name string, content binary"), stages.folder(t.spark, "npz"))
    a = B.file_parts(t.spark.read.format("binaryFile").load(folder)).where("part <> 'header' OR part IS NULL")
    said = lambda label: F.regexp_extract("value", rf"(?m)^  {label}: (.*)$", 1)
    number = lambda label: said(label).cast("double")
    return a.select(B.title(F.col("path")).alias("title"), F.col("part").alias("array"), said("Shape").alias("shape"), said("Data type").alias("dtype"), number("Min").alias("low"), number("Max").alias("high"), number("Mean").alias("mean"), number("Std").alias("std"), said("Sample values").alias("first_five"))


@query("files_extracted", """SELECT 'csv-' || p_size AS title, 1 AS page_count, 'Dataset: csv-' || p_size || chr(10) || 'Columns: p_partkey, p_name, p_brand' || chr(10) || 'Total records: ' || count(*) || chr(10) || chr(10) || string_agg('p_partkey: ' || p_partkey || ' | p_name: ' || p_name || CASE WHEN p_partkey % 3 > 0 THEN ' | p_brand: ' || p_brand ELSE '' END, chr(10) ORDER BY p_partkey) AS text, 'en' AS language, NULL AS error FROM part GROUP BY p_size
UNION ALL SELECT 'chat-' || conv_id % 20, count(*)::INT, string_agg('Turn of ' || role || ' number ' || conv_id || '-' || turn, chr(10) || chr(10) ORDER BY conv_id, turn), 'en', NULL FROM conversations GROUP BY conv_id % 20
UNION ALL SELECT 'item-' || item_id, 1, CASE WHEN item_id % 2 = 0 THEN 'دما ' ELSE '' END || text, CASE WHEN item_id % 2 = 0 THEN 'fa' ELSE 'en' END, NULL FROM benchmark
UNION ALL SELECT 'order-' || o_orderkey, 1, 'JSON Dataset: order-' || o_orderkey || chr(10) || chr(10) || 'key: ' || o_orderkey || chr(10) || 'status: ' || o_orderstatus, 'en', NULL FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT 'nation-' || n_nationkey, 1, NULL, 'en', 'unsupported type .doc' FROM nation""")
def _(t: Tables) -> DataFrame:
    """CSV, paged, plain and JSON files in one folder tree, each through the reader of its suffix; one kind has none."""
    joined = lambda key, order, line, between: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), between)
    brand = F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise(F.lit(" "))
    cells = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", brand)
    csv = t.part.groupBy("p_size").agg(joined("p_size", ["p_partkey"], cells, "\n").alias("c")).select(F.concat(F.lit("tables/csv-"), F.col("p_size"), F.lit(".csv")).alias("name"), F.concat(F.lit("p_partkey,p_name,p_brand\n"), "c", F.lit("\n1,a,b,one too many\n")).alias("content"))
    said = F.concat(F.lit(" Turn of "), "role", F.lit(" number "), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit("\n 12 \nPage 7\n"))
    pages = t.conversations.withColumn("k", F.col("conv_id") % 20).groupBy("k").agg(joined("k", ["conv_id", "turn"], said, "\f").alias("c")).select(F.concat(F.lit("chats/chat-"), "k", F.lit(".PDF")).alias("name"), F.concat("c", F.lit("\f \n")).alias("content"))
    plain = t.benchmark.select(F.concat(F.lit("items/deep/item-"), "item_id", F.lit(".txt")).alias("name"), F.concat(F.when(F.col("item_id") % 2 == 0, "دما ").otherwise(""), "text").alias("content"))
    json = t.orders.where("o_orderkey % 50 = 0").select(F.concat(F.lit("order-"), "o_orderkey", F.lit(".json")).alias("name"), F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("content"))
    other = t.nation.select(F.concat(F.lit("nation-"), "n_nationkey", F.lit(".doc")).alias("name"), F.lit("x").alias("content"))
    every = csv.union(pages).union(plain).union(json).union(other).withColumn("content", F.col("content").cast("binary"))
    return B.extracted(t.spark, B.write_files(every, stages.folder(t.spark, "mixed"))).select("title", "page_count", "text", "language", "error")


@query("file_queue", """WITH f AS (SELECT doc_id % 40 AS k, count(*) FILTER (WHERE length(trim(replace(text, chr(10), ' '))) >= 50) AS n FROM documents GROUP BY 1)
SELECT 'f' || k AS title, a.attempt::INT AS attempt, CASE WHEN a.attempt < last OR n = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN a.attempt < last THEN 0 ELSE n END AS chunk_count, CASE WHEN a.attempt < last THEN 'bad' WHEN n = 0 THEN 'no chunks' END AS error, CASE WHEN a.attempt = last THEN n ELSE 0 END AS stored
FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 3 WHEN k % 5 = 1 THEN 2 ELSE 1 END AS last FROM f), range(1, 4) a(attempt) WHERE a.attempt <= last""")
def _(t: Tables) -> DataFrame:
    """Documents in 40 paged files, some broken twice and some once; a stream, two further tries with files mended between, and the log with what each try stored."""
    store, line = stages.folder(t.spark, "queue"), F.regexp_replace("text", "[\n\f]", " ")
    pages = t.documents.select((F.col("doc_id") % 40).alias("k"), line.alias("page"))
    breaks = F.when(F.col("k") % 5 == 0, 2).when(F.col("k") % 5 == 1, 1).otherwise(0)
    broken = "BROKEN\n"  # as no document's page is

    def put(try_no: int, rows: DataFrame) -> str:
        bad = rows.where(breaks > try_no).select("k").distinct().select("k", F.lit(broken).alias("page"))
        return B.write_pages(rows.where(breaks <= try_no).union(bad).select(F.concat(F.lit("f"), "k", F.lit(".pdf")).alias("name"), "page"), f"{store}/in")

    def read(title: str, file: BinaryIO) -> Iterator[tuple[str, int, str]]:
        for _, i, page in B.stream_pages(title, file):
            if page == broken:
                raise ValueError("bad")
            yield "line", i, page

    def chunk(parts: DataFrame) -> DataFrame:
        return parts.select("path", F.col("position").alias("chunk"), F.col("text").alias("content")).where(F.length(F.trim("content")) >= 50)

    readers = {".pdf": B.Streamed(read)}
    folder = put(0, pages)
    Q.watch(t.spark, folder, f"{store}/out", chunk, readers, files_a_batch=15, by_part=True).awaitTermination()
    for try_no in (1, 2):
        put(try_no, pages.where(breaks >= try_no))
        Q.retry(t.spark, f"{store}/out", chunk, readers, files_a_run=10, by_part=True)
    stored = Q.chunks(t.spark, f"{store}/out").groupBy("path").agg(F.count("*").alias("n"))
    rows = Q.log(t.spark, f"{store}/out").join(stored, "path", "left")
    return rows.select(B.title(F.col("path")).alias("title"), "attempt", "status", "chunk_count", F.regexp_replace("error", "^ValueError: ", "").alias("error"), F.when(F.col("status") == "completed", F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("stored"))
