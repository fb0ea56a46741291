"""Keyed tables with upserts and deletes, and table functions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import table_functions
from ..sources import stages
from ..sources.keyed_table import KeyedTable
from ..streaming import jobs
from . import registry
from .registry import Tables, query


@query("keyed_upsert_stream", "SELECT user_id, event_type, last(value ORDER BY ts, event_id) AS value, max(ts) AS updated_at FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """A stream of files into a keyed table, a batch rewriting its own buckets."""
    path = stages.folder(t.spark, "keyed")
    rows = t.events.select("user_id", "event_type", "value", "ts", "event_id")
    rows.repartition(3, "event_id").write.parquet(f"{path}/in")
    table = KeyedTable(t.spark, f"{path}/table", rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), ["user_id", "event_type"], buckets=16)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    jobs.run_batches(stream, lambda batch, number: table.upsert(batch, ["ts", "event_id"], number), f"{path}/checkpoint").awaitTermination()
    return table.read().select("user_id", "event_type", "value", F.col("ts").alias("updated_at"))


@query("keyed_delete", "SELECT doc_id, source, (SELECT count(*) FROM documents WHERE source = 'src3') AS deleted FROM documents WHERE source <> 'src3'")
def _(t: Tables) -> DataFrame:
    """All documents of a source taken out of a keyed table."""
    table = KeyedTable(t.spark, stages.folder(t.spark, "keyed"), "doc_id bigint, source string", ["doc_id"], buckets=16)
    table.upsert(t.documents.select("doc_id", "source"), ["source"])
    deleted = table.delete(F.col("source") == "src3")
    return table.read().withColumn("deleted", F.lit(deleted).cast("long"))


@query("chunk_udtf", registry.ORACLE_SQL["chunk_fixed"])
def _(t: Tables) -> DataFrame:
    table_functions.register(t.spark)
    t.documents.createOrReplaceTempView("documents")
    return t.spark.sql("SELECT id AS doc_id, chunk, content FROM fixed_chunks(TABLE(SELECT doc_id AS id, text FROM documents))")


@query("repair_udtf", "SELECT sum(1)::BIGINT AS objects, sum(conv_id)::BIGINT AS total FROM conversations")
def _(t: Tables) -> DataFrame:
    table_functions.register(t.spark)
    t.conversations.createOrReplaceTempView("conversations")
    return t.spark.sql("""SELECT count(*) AS objects, sum(CAST(get_json_object(object, '$.conv_id') AS BIGINT)) AS total
    FROM json_objects(TABLE(SELECT conv_id AS id, 'junk } ' || array_join(collect_list(to_json(struct(conv_id, turn, text))), ' , ') || ' {"open": "{' AS text FROM conversations GROUP BY conv_id))""")


@query("search_similar", """WITH s AS (SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings)
SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM s WHERE similarity > 0.1 QUALIFY rank <= 20""")
def _(t: Tables) -> DataFrame:
    t.embeddings.select(F.col("vec_id").alias("id"), "embedding").createOrReplaceTempView("vectors")
    table_functions.register_search(t.spark, "vectors")
    return t.spark.sql("SELECT id, round(similarity, 6) AS similarity, rank FROM search_similar((SELECT CAST(embedding AS ARRAY<DOUBLE>) FROM vectors WHERE id = 0), 0.1D, 20)")
