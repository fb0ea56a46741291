"""An inverted index as tables: built once from a corpus, asked by any table of queries without reading the corpus again.

Documents are dealt into ranges of ``DOCS`` as they are read. A posting row holds one term's documents of one range, their weights and the largest of
them. For a query, the largest weights of its terms in a range add up to a bound on every score there; ranges whose bound is below the n-th best score
found so far are skipped, and only the others' postings are read. Results are exact. A term that every document has is spread over as many rows as there are ranges.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stages import written
from .ranking import top

DOCS, BUCKETS = 64, 64
#: A bucket's rows are written by so many tasks, so that a term that every document has is not one task's.
SPREAD = 16
#: So many of a query's most promising ranges give the score that the others have to reach.
SEEDS = 12
#: Scores are rounded to six places; a bound must be lower by more than that to skip.
SLACK = 1e-5


_BLOCKS = "term string, range long, docs array<struct<no: int, id: long, w: double>>, most double, n long"


def _blocks(mean: float, k1: float, b: float, docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each term of each range; a range is ``docs`` documents as a task reads them."""

    def rows(number: int, held: dict[str, list[tuple[int, int, float]]]) -> pa.RecordBatch:
        n = [len(x) for x in held.values()]
        no, ids, w = (np.array(c) for c in zip(*(p for x in held.values() for p in x)))
        starts = np.concatenate([[0], np.cumsum(n)])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(no, pa.int32()), pa.array(ids, pa.int64()), pa.array(w, pa.float64())], ["no", "id", "w"]))
        columns = [pa.array(list(held), pa.string()), pa.array([number] * len(n), pa.int64()), lists, pa.array(np.maximum.reduceat(w, starts[:-1])), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["term", "range", "docs", "most", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen, held = TaskContext.get().partitionId() << 32, 0, {}
        for batch in batches:
            for of, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = Counter(words.as_py() or ())
                dl = counts.total()
                for term, tf in counts.items():
                    held.setdefault(term, []).append((seen % docs, of, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))))
                seen += 1
                if seen % docs == 0 and held:
                    yield rows(number + seen // docs, held)
                    held = {}
        if held:
            yield rows(number + seen // docs + 1, held)

    return run


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(corpus: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, docs: int = DOCS) -> None:
    """Writes ``path``/postings (by bucket of the term, sorted by term and range) and ``path``/terms for ``corpus`` (id, text).

    Null and blank texts count as documents without words. An id given twice is two documents with one id. What is shuffled is a row for each term
    and range, put together where the documents are read.
    """
    words = corpus.select(F.col("id").cast("long").alias("id"), F.coalesce(X.tokens(F.lower("text")), F.array().cast("array<string>")).alias("words"))
    count, mean = words.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(0.0))).head()
    blocks = words.where(F.size("words") > 0).mapInArrow(_blocks(max(mean, 1e-9), k1, b, docs), _BLOCKS).withColumn("bucket", bucket(F.col("term")))
    blocks.repartition("bucket", F.pmod("range", F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = corpus.sparkSession.read.schema(f"{_BLOCKS}, bucket int").parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))).write.parquet(f"{path}/terms")


class Index:
    """A stored index. ``search`` gives a query set's best documents, ``effort`` how much of the index it took."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings = spark.read.schema(f"{_BLOCKS}, bucket int").parquet(f"{path}/postings")
        self.terms = spark.read.schema("term string, df long, idf double").parquet(f"{path}/terms")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, bucket, idf) of a stated query set, each term once."""
        rows = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.lower("text")))).alias("term")).withColumn("bucket", bucket(F.col("term")))
        return written(rows.join(self.terms.drop("df"), "term"), "asked")

    def _scored(self, asked: DataFrame, ranges: DataFrame) -> DataFrame:
        """(query_id, id, score) over the given (query_id, range)."""
        found = asked.join(self.postings.select("bucket", "term", "range", "docs"), ["bucket", "term"]).join(ranges.select("query_id", "range"), ["query_id", "range"])
        rows = found.select("query_id", "range", "idf", F.explode("docs").alias("d"))
        scores = rows.groupBy("query_id", "range", F.col("d.no").alias("no"), F.col("d.id").alias("id")).agg(F.round(F.sum(F.col("idf") * F.col("d.w")), 6).alias("score"))
        return scores.select("query_id", "id", "score")

    def _bounds(self, asked: DataFrame) -> DataFrame:
        """(query_id, range, bound, n) from the largest weights alone; the documents of the postings are not read."""
        heads = asked.join(self.postings.select("bucket", "term", "range", "most", "n"), ["bucket", "term"])
        return heads.groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.sum("n").alias("n"))

    def _needed(self, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        asked = self._asked(queries)
        bounds = written(self._bounds(asked), "bounds")
        seeds = top(bounds, ["query_id"], [F.desc("bound"), F.col("range")], SEEDS)
        best = top(self._scored(asked, seeds), ["query_id"], [F.desc("score"), F.col("id")], n).where(F.col("rank") == n).select("query_id", F.col("score").alias("least"))
        return asked, bounds, written(bounds.join(best, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK), "ranges")

    def search(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, id, score, rank), the rows of ``ranking.bm25`` over the indexed corpus; ``queries``: query_id, text."""
        asked, _, ranges = self._needed(queries, n)
        return top(self._scored(asked, ranges).where("score > 0"), ["query_id"], [F.desc("score"), F.col("id")], n)

    def effort(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, matched, read): postings that match and those in ranges that are not skipped."""
        _, bounds, ranges = self._needed(queries, n)
        rows = bounds.groupBy("query_id").agg(F.sum("n").alias("matched"))
        return rows.join(ranges.groupBy("query_id").agg(F.sum("n").alias("read")), "query_id", "left").na.fill(0)
