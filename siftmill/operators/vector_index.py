"""Approximate neighbours that prune: trained coarse centroids, inverted lists, short codes of the residuals, exact scores for the few that remain.

Centroids and code books are trained on at most ``SAMPLE`` vectors; every vector is assigned and coded. A query looks into its ``probes`` nearest lists, scores their
codes by table lookups, and fetches the vectors of the best ``refine`` only. Vectors are unit vectors, scores are cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import written
from .ranking import _in_blocks, dot, top

#: Vectors that the training sees; a parameter of ``train``.
SAMPLE = 20_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), len(centres))])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


@dataclass
class Books:
    """``centres`` (lists, dims) and, for each stretch of dimensions, a code book of residuals (stretches, words, width)."""

    centres: np.ndarray
    words: np.ndarray

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.centres)
        rest = (x - self.centres[own]).reshape(len(x), len(self.words), -1)
        return own, np.stack([_nearest(rest[:, m], self.words[m]) for m in range(len(self.words))], axis=1).astype(np.uint8)


def train(corpus: DataFrame, lists: int = 64, stretches: int = 16, sample: int = SAMPLE, seed: int = 7) -> Books:
    """Books from at most ``sample`` vectors, those first by the hash of their id; null vectors are left out."""
    rows = corpus.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    x = np.array([r[0] for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    centres = _kmeans(x, max(1, min(lists, len(x) // 8)), rng)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), stretches, -1)
    return Books(centres, np.stack([_kmeans(rest[:, m], min(256, len(x)), rng) for m in range(stretches)]))


def build_lists(corpus: DataFrame, books: Books) -> DataFrame:
    """(id, list, code) of every vector of ``corpus`` (id, vector), written by list."""
    held = corpus.sparkSession.sparkContext.broadcast(books)  # lists * dims and 256 * dims numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), np.float64)
                own, codes = held.value.codes(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

    coded = corpus.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "id long, list int, code binary")
    return written(coded, "lists")


def candidates(lists: DataFrame, queries: DataFrame, books: Books, probes: int, refine: int, block: int = 256) -> DataFrame:
    """(query_id, id, guess, rank): of the ``probes`` lists nearest to a query, the best ``refine`` by their codes. ``queries`` (query_id, vector) is a stated set, sent in blocks."""
    spark, out = lists.sparkSession, None
    for own in _in_blocks(queries.select("query_id", "vector"), max(1, -(-queries.count() // block))):
        rows = own.collect()
        if not rows:
            continue
        q = np.array([r[1] for r in rows], np.float64)
        near = q @ books.centres.T
        looked = np.zeros(near.shape, bool)
        np.put_along_axis(looked, np.argsort(-near, axis=1)[:, :probes], True, axis=1)
        tables = np.einsum("qmd,mkd->mkq", q.reshape(len(q), len(books.words), -1), books.words)
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), near, looked, tables))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, near, looked, tables = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    own, keys = part.column(1).to_numpy(), part.column(0).to_numpy()
                    guess = near[:, own].T + sum(tables[m, codes[:, m]] for m in range(codes.shape[1]))
                    guess = np.where(looked[:, own].T, guess, -np.inf)
                    n = min(refine, len(keys))
                    best = np.argpartition(-guess, n - 1, axis=0)[:n]
                    row, col = best.T.ravel(), np.repeat(np.arange(len(ids)), n)
                    kept = np.isfinite(guess[row, col])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[col[kept]], pa.int64()), pa.array(keys[row[kept]], pa.int64()), pa.array(guess[row, col][kept])], names=["query_id", "id", "guess"])

        found = lists.mapInArrow(run, "query_id long, id long, guess double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, guess double")
    return top(out, ["query_id"], [F.desc("guess"), F.col("id")], refine)


def neighbours(corpus: DataFrame, queries: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(query_id, id, similarity, rank) by exact scores of ``candidates``."""
    pairs = found.select("query_id", "id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id").join(corpus.select("id", "vector"), "id")
    scored = pairs.select("query_id", "id", F.round(dot(F.col("q"), F.col("vector")), 6).alias("similarity"))
    return top(scored, ["query_id"], [F.desc("similarity"), F.col("id")], n)
