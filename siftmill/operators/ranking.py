"""Lexical and vector ranking for whole tables of queries, rank fusion and re-ranking.

Ranked tables have query_id, id, rank and a score; ties go to the smaller id. Scores are rounded before they
are ranked, so that the order of a sum does not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as X
from ..sources.stages import written

#: Additive weight of a source type; fixed values.
BOOSTS = {"textbook": 0.15, "qa_pair": 0.10, "standard": 0.08, "sop": 0.05, "manual": 0.02, "paper": -0.03}


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; pruned before the shuffle by a group limit."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def _in_blocks(queries: DataFrame, n_blocks: int) -> list[DataFrame]:
    """The queries dealt by hash."""
    return [queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == k) for k in range(n_blocks)]


def _best(queries: np.ndarray, keys: np.ndarray, scores: np.ndarray, n: int, positive: bool = False) -> pd.DataFrame:
    """The first ``n`` keys of each query by score (one column a query), ties by key."""
    rows = []
    for q in range(len(queries)):
        order = np.lexsort((keys, -scores[:, q]))[:n]
        order = order[scores[order, q] > 0] if positive else order
        rows.append((np.full(len(order), queries[q]), keys[order], scores[order, q]))
    query, key, score = (np.concatenate(x) for x in zip(*rows))
    return pd.DataFrame({"query_id": query, "id": key, "score": score})


def _term_counts(terms: list[str]):
    """Arrow batches of (id, words) to (id, dl, codes, counts): what a document has of the asked terms, counted in its row."""
    known = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):  # a worker holds the words of so many texts
            words = batch.column(1)
            n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.index_in(words.flatten(), value_set=known)
            row = np.repeat(np.arange(len(n)), n)[code.is_valid().to_numpy(zero_copy_only=False)]
            found, times = np.unique(row * max(1, len(terms)) + code.drop_null().to_numpy(), return_counts=True)
            ends = np.searchsorted(found, np.arange(len(n) + 1) * max(1, len(terms))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (found % max(1, len(terms)), times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["id", "dl", "codes", "counts"])

    return run


def bm25(corpus: DataFrame, queries: DataFrame, n: int, k1: float = 1.5, b: float = 0.75, block: int = 128, most_terms: int = 1_000_000) -> DataFrame:
    """(query_id, id, score, rank) by corpus-wide Okapi weights; only documents that share a term are scored.

    ``corpus``: id (a long), text. ``queries``: query_id, text; a stated set. The corpus is tokenised once: each row counts
    its asked terms, and these counts are written. From them come document frequencies and, for ``block`` queries at a
    time, the scores; only each query's first ``n`` of a batch leave a task, so no postings are shuffled. Queries
    with more than ``most_terms`` terms in all are dealt into several runs.
    """
    spark = corpus.sparkSession
    terms_of = lambda q: q.select("query_id", F.array_distinct(X.tokens(F.lower("text"))).alias("terms"))
    n_terms = terms_of(queries).select(F.explode("terms").alias("t")).agg(F.count_distinct("t")).head()[0]
    parts = [_bm25(spark, corpus, terms_of(own), n, k1, b, block) for own in _in_blocks(queries, max(1, -(-n_terms // most_terms)))]
    found = reduce(DataFrame.unionByName, [p for part in parts for p in part] or [spark.createDataFrame([], "query_id long, id long, score double")])
    return top(found, ["query_id"], [F.desc("score"), F.col("id")], n)


def _bm25(spark, corpus: DataFrame, asked: DataFrame, n: int, k1: float, b: float, block: int) -> list[DataFrame]:
    terms = [r[0] for r in asked.select(F.explode("terms")).distinct().collect()]  # of the stated queries, bounded by the caller
    words = corpus.select(F.col("id").cast("long").alias("id"), X.tokens(F.lower("text")).alias("w"))
    counted = written(words.mapInArrow(_term_counts(terms), "id long, dl long, codes array<int>, counts array<int>"), "bm25")
    docs, mean = counted.agg(F.count("*"), F.avg("dl")).head()
    df = np.zeros(len(terms))
    for code, count in counted.select(F.explode("codes").alias("c")).groupBy("c").count().collect():  # at most a row a term
        df[code] = count
    idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
    place = {t: i for i, t in enumerate(terms)}
    out = []
    for own in _in_blocks(asked, max(1, -(-asked.count() // block))):
        rows = [(q, t) for q, t in own.collect() if t]
        if not rows:
            continue
        weights = np.zeros((len(terms), len(rows)), dtype=np.float64)
        for j, (_, its) in enumerate(rows):
            codes = [place[t] for t in its]
            weights[codes, j] = idf[codes]
        used = np.flatnonzero(weights.any(axis=1))
        number = np.full(len(terms), -1)
        number[used] = np.arange(len(used))
        held = spark.sparkContext.broadcast((np.array([q for q, _ in rows]), number, weights[used]))  # a block's terms times its queries

        def score(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pd.DataFrame]:
            ids, number, weights = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    dl, codes = part.column(1).to_numpy(), number[part.column(2).flatten().to_numpy()]
                    size = pc.list_value_length(part.column(2)).to_numpy()
                    used = codes >= 0
                    codes, doc, tf = codes[used], np.repeat(np.arange(len(size)), size)[used], part.column(3).flatten().to_numpy()[used].astype(np.float64)
                    part_of, starts = np.unique(doc, return_index=True)
                    if not len(part_of):
                        continue
                    tf *= (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / mean))
                    s = np.zeros((len(part_of), len(ids)))
                    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(doc)])):  # one product a document: its terms against the block
                        s[k] = tf[lo:hi] @ weights[codes[lo:hi]]
                    yield pa.RecordBatch.from_pandas(_best(ids, part.column(0).to_numpy()[part_of], np.where(s > 0, np.maximum(np.round(s, 6), 1e-300), 0), n, positive=True), preserve_index=False)

        out.append(counted.mapInArrow(score, "query_id long, id long, score double").withColumn("score", F.round("score", 6)))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(v: Column, prefix: int | None = None) -> Column:
    """A unit vector, of the first ``prefix`` places if given; a zero vector stays."""
    v = F.slice(v, 1, prefix) if prefix else v
    once = lambda c, use: F.transform(F.array(c), use)[0]  # noqa: E731  # a lambda's argument is computed once a row, not once a place
    return once(v, lambda a: once(F.sqrt(dot(a, a)), lambda norm: F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))))


def knn(corpus: DataFrame, queries: DataFrame, n: int, threshold: float | None = None, block: int = 512) -> DataFrame:
    """(query_id, id, similarity, rank): exact nearest unit vectors, for a stated set of queries in blocks.

    ``corpus``: id, vector; ``queries``: query_id, vector. Queries are sent in blocks of ``block``; in each batch of
    the corpus a matrix product scores them and only each query's first ``n`` of the batch leave the task.
    """
    spark = corpus.sparkSession
    numbered = queries.select("query_id", "vector")
    out = None
    for own in _in_blocks(numbered, max(1, -(-numbered.count() // block))):
        rows = own.collect()  # about ``block`` queries, none of the corpus
        if not rows:
            continue
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)))

        def score(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, matrix = held.value
            for batch in batches:
                if len(batch):
                    s = np.round(np.stack(batch["vector"].to_numpy()).astype(np.float64) @ matrix.T, 6)
                    yield _best(ids, batch["id"].to_numpy(), s, n).rename(columns={"score": "similarity"})

        part = corpus.select("id", "vector").mapInPandas(score, "query_id long, id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, similarity double")
    best = top(out, ["query_id"], [F.desc("similarity"), F.col("id")], n)
    return best if threshold is None else best.where(F.col("similarity") > threshold)


def two_pass(corpus: DataFrame, queries: DataFrame, priority: Column, top_k: int, threshold: float) -> DataFrame:
    """Priority rows first (half as many again as ``top_k``), then all (three times); rows of the first pass stay ahead."""
    first = knn(corpus.where(priority), queries, top_k * 3 // 2).withColumn("pass_no", F.lit(1))
    second = knn(corpus, queries, top_k * 3).withColumn("pass_no", F.lit(2))
    both = first.unionByName(second).where(F.col("similarity") >= threshold)
    one = both.groupBy("query_id", "id").agg(F.min(F.struct("pass_no", "rank", "similarity")).alias("m")).select("query_id", "id", "m.pass_no", "m.similarity", F.col("m.rank").alias("pass_rank"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pass_no", "pass_rank", "id"))).drop("pass_rank")


def rrf(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; ties go to the earlier list, then the smaller id."""
    parts = [d.select("query_id", "id", (F.lit(1.0) / (k + F.col("rank"))).alias("s"), F.lit(i).alias("list_no")) for i, d in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"), F.min("list_no").alias("list_no"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "list_no", "id")))


def overlap_score(query: Column, passage: Column, first: int = 2000) -> Column:
    """Default scorer: share of the query's words that the passage has."""
    q = F.array_distinct(X.tokens(F.lower(query)))
    return F.round(F.size(F.array_intersect(q, X.tokens(F.lower(F.substring(passage, 1, first))))) / F.greatest(F.size(q), F.lit(1)), 6)


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 16) -> Callable[[Column, Column], Column]:
    """A scorer column from a user's pair model; the model is loaded once in a worker and called in batches."""

    @pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, p in pairs:
            yield pd.Series([s for i in range(0, len(q), batch) for s in model(q[i : i + batch].tolist(), p[i : i + batch].tolist())], dtype="float64")

    return score


def model_encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> Callable[[Column], Column]:
    """A vector column from a user's text model; the model is loaded once in a worker and called in batches."""

    @pandas_udf("array<double>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for t in texts:
            t = t.fillna("")
            yield pd.Series([list(map(float, v)) for i in range(0, len(t), batch) for v in model(t[i : i + batch].tolist())], dtype=object)

    return encode


def vectorise(df: DataFrame, key: str, text: str, encoder: Callable[[Column], Column] | None = None, dims: int = 256) -> DataFrame:
    """(key, vector): unit vectors by the encoder, or hashed terms weighted by inverse document frequency; null for texts without words."""
    if encoder is not None:
        return df.select(key, encoder(F.col(text)).alias("raw")).select(key, l2_normalise(F.col("raw")).alias("vector"))
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    words = df.select(key, F.coalesce(X.tokens(F.lower(text)), F.array().cast("array<string>")).alias("words"))
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=dims).transform(words)
    counted = written(hashed.select(key, "tf", (F.size("words") > 0).alias("any")), "terms")  # words are cut and hashed once, for the frequencies and for the weights
    weighted = IDF(inputCol="tf", outputCol="weight").fit(counted).transform(counted)
    return weighted.select(key, F.when(F.col("any"), l2_normalise(vector_to_array("weight"))).alias("vector"))


def same_questions(questions: DataFrame, key: str, *decisive: Column) -> DataFrame:
    """(key, runs_as): each question with the first one that is equal in everything that decides its result."""
    hashed = questions.select(key, F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in decisive))).alias("same"))
    return hashed.join(hashed.groupBy("same").agg(F.min(key).alias("runs_as")), "same").select(key, "runs_as")


def rerank(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, n: int, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """A second score on query and passage decides; equal scores keep the given order; always at most ``n`` rows."""
    joined = ranked.join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(corpus.select("id", F.col("text").alias("p")), "id")
    scored = joined.withColumn("rerank_score", scorer(F.col("q"), F.col("p"))).withColumnRenamed("rank", "given").drop("q", "p")
    return top(scored, ["query_id"], [F.desc("rerank_score"), F.col("given"), F.col("id")], n).drop("given")


def boost(ranked: DataFrame, source_type: Column, score: str, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """Adds a source type's weight, keeps scores in 0..1 and ranks again."""
    table = F.create_map(*[x for k, v in boosts.items() for x in (F.lit(k), F.lit(v))])
    added = F.coalesce(F.try_element_at(table, source_type), F.lit(0.0))
    d = ranked.withColumn(score, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) + added)), 6)).withColumnRenamed("rank", "given")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "given", "id"))).drop("given")


def pack_context(ranked: DataFrame, text: str, score: str, budget: int = 7200, start: int = 60, cut: int = 1000, weak_cut: int = 500, weak: float = 0.5) -> DataFrame:
    """Chunks in rank order, shortened, up to the first after the third that would pass the budget."""
    short = F.when((F.col("rank") > 3) & (F.col(score) < weak), F.substring(text, 1, weak_cut)).otherwise(F.substring(text, 1, cut))
    w = Window.partitionBy("query_id").orderBy("rank")
    d = ranked.withColumn("piece", short).withColumn("used", F.lit(start) + F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.min(F.when((F.col("rank") > 3) & (F.col("used") > budget), F.col("rank"))).over(Window.partitionBy("query_id"))
    d = d.withColumn("stop", over).where(F.col("stop").isNull() | (F.col("rank") < F.col("stop")))
    packed = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("p"), F.count("*").alias("n_chunks"))
    return packed.select("query_id", "n_chunks", F.array_join("p.piece", "\n---\n").alias("context"))


def _lsh_best(queries: np.ndarray, keys: np.ndarray, scores: np.ndarray, n: int) -> pd.DataFrame:
    """As ``_best``, where -inf marks what is no candidate; only what reaches a query's n-th score is sorted."""
    least = np.partition(scores, len(keys) - n, axis=0)[len(keys) - n] if len(keys) > n else np.full(len(queries), -np.inf)
    row, q = np.nonzero((scores >= least) & (scores > -np.inf))
    order = np.lexsort((keys[row], -scores[row, q], q))
    row, q = row[order], q[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < n
    row, q = row[first], q[first]
    return pd.DataFrame({"query_id": queries[q], "id": keys[row], "similarity": scores[row, q]})


def lsh_neighbours(corpus: DataFrame, queries: DataFrame, n: int, dims: int, tables: int = 32, bits: int = 12, probes: int = 2, reach: int = 10, seed: int = 42, block: int = 512) -> DataFrame:
    """Approximate nearest vectors: random-hyperplane signs in ``tables`` bands, and exact scores of the vectors in a query's buckets.

    A query looks also into the buckets that differ in up to ``probes`` of its ``reach`` least certain signs (of the
    planes it lies closest to). ``block`` queries at a time are sent as a bit set for each bucket; a vector takes the sets of
    its ``tables`` buckets together, so candidate pairs are never rows: only each query's first ``n`` of a batch leave a task.
    """
    spark = corpus.sparkSession
    planes = np.random.default_rng(seed).standard_normal((dims, tables * bits))
    flips = [f for k in range(probes + 1) for f in combinations(range(min(bits, reach)), k)]
    power, band = np.int64(1) << np.arange(bits, dtype=np.int64), np.arange(tables, dtype=np.int64) << bits

    def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (vectors @ planes).reshape(len(vectors), tables, bits)
        return at, ((at > 0) * power).sum(axis=2)

    def buckets(vectors: np.ndarray) -> np.ndarray:
        """A bit for each query in each bucket it looks into."""
        at, code = codes(vectors)
        unsure = power[np.argsort(np.abs(at), axis=2)]
        sets = np.zeros((tables << bits, -(-len(vectors) // 8)), np.uint8)
        bit = (np.uint8(1) << (np.arange(len(vectors)) % 8).astype(np.uint8))[:, None]
        for f in flips:
            found = (code ^ sum((unsure[:, :, i] for i in f), np.int64(0))) + band
            np.bitwise_or.at(sets, (found, np.arange(len(vectors))[:, None] // 8), bit)
        return sets

    out = None
    for own in _in_blocks(queries.select("query_id", "vector"), max(1, -(-queries.count() // block))):
        rows = own.collect()  # about ``block`` queries, none of the corpus
        if not rows:
            continue
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)))

        def score(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, matrix = held.value
            sets = buckets(matrix)
            for batch in batches:
                for lo in range(0, len(batch), 2000):
                    part = batch.iloc[lo : lo + 2000]
                    vectors = np.stack(part["vector"].to_numpy()).astype(np.float64)
                    met = np.zeros((len(part), sets.shape[1]), np.uint8)
                    for at in (codes(vectors)[1] + band).T:
                        met |= sets[at]
                    near = np.unpackbits(met, axis=1, count=len(ids), bitorder="little") > 0
                    yield _lsh_best(ids, part["id"].to_numpy(), np.where(near, np.round(vectors @ matrix.T, 6), -np.inf), n)

        part = corpus.select("id", "vector").mapInPandas(score, "query_id long, id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, similarity double")
    return top(out, ["query_id"], [F.desc("similarity"), F.col("id")], n)
