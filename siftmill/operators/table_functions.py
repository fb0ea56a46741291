"""Table functions for SQL: chunkers and JSON repair over a table argument, and threshold search over a view of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..sources.readers import top_level_objects
from . import chunking

CHUNKS, OBJECTS = "id bigint, chunk int, content string", "id bigint, at int, object string"


def _row_function(generate: Callable[[str], Iterator[str] | list[str]], returns: str):
    """A UDTF over rows (id, text), numbered within a row; null and blank texts give none."""

    class Rows:
        def eval(self, row: Row):
            if row["text"] and row["text"].strip():
                for i, piece in enumerate(generate(row["text"])):
                    yield row["id"], i, piece

    return udtf(Rows, returnType=returns)


def register(spark: SparkSession) -> None:
    """Registers for SQL: ``fixed_chunks``, ``paragraph_chunks``, ``sentence_chunks`` and ``json_objects``, each of ``TABLE(rows)`` with columns id and text."""
    for name in ("fixed_chunks", "paragraph_chunks", "sentence_chunks"):
        spark.udtf.register(name, _row_function(getattr(chunking, name), CHUNKS))
    spark.udtf.register("json_objects", _row_function(top_level_objects, OBJECTS))


def register_search(spark: SparkSession, view: str, parts: int = 64) -> None:
    """Registers ``search_similar(query, threshold, n)`` over ``view`` (id, embedding of unit length): the ``n`` most similar rows above the threshold, ties by id.

    Each of ``parts`` shares keeps its own first ``n``, so the last ranking sees at most ``parts`` times ``n`` rows.
    """
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION search_similar(query ARRAY<DOUBLE>, threshold DOUBLE, n INT) RETURNS TABLE (id BIGINT, similarity DOUBLE, rank INT)
    RETURN WITH s AS (SELECT id, aggregate(zip_with(CAST(embedding AS ARRAY<DOUBLE>), search_similar.query, (x, y) -> x * y), 0D, (a, x) -> a + x) AS similarity FROM {view}),
    p AS (SELECT *, row_number() OVER (PARTITION BY pmod(hash(id), {parts}) ORDER BY similarity DESC, id) AS own FROM s WHERE similarity > search_similar.threshold),
    r AS (SELECT id, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INT) AS rank FROM p WHERE own <= search_similar.n)
    SELECT id, similarity, rank FROM r WHERE rank <= search_similar.n""")
