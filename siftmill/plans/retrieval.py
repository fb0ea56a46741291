"""Lexical, dense and hybrid retrieval for whole query tables, their evaluation and context packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexical_index as L
from ..operators import ranking as R
from ..operators import vector_index as V
from ..sources import stages
from .registry import Tables, query

_TOK = r"list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda x: x <> '')"


def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text", "source", "lang")


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vectors(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _bm25_sql(n: int) -> str:
    return f"""w AS (SELECT doc_id AS id, {_TOK.format(t='text')} AS w FROM documents), s AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM w),
a AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format(t='text')}) AS term FROM benchmark), p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), c AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM a JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM c) WHERE rank <= {n})"""


@query("bm25", f"WITH {_bm25_sql(5)} SELECT query_id, id, score, rank FROM bm")
def _(t: Tables) -> DataFrame:
    return R.bm25(corpus(t), asked(t), 5).select("query_id", "id", "score", "rank")


@query("bm25_index", f"WITH {_bm25_sql(5)} SELECT query_id, id, score, rank FROM bm")
def _(t: Tables) -> DataFrame:
    """The same ranking from a stored inverted index."""
    path = stages.folder(t.spark, "index")
    L.build_index(corpus(t), path)
    return L.Index(t.spark, path).search(asked(t), 5)


_KNN = "k AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)"


def _top(source: str, n: int, extra: str = "") -> str:
    return f"(SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM {source} {extra}) WHERE rank <= {n})"


@query("knn_exact", f"WITH {_KNN} SELECT * FROM {_top('k', 10)}")
def _(t: Tables) -> DataFrame:
    return R.knn(vectors(t), query_vectors(t), 10)


@query("knn_threshold", f"WITH {_KNN} SELECT * FROM {_top('k', 10)} WHERE similarity > 0.2")
def _(t: Tables) -> DataFrame:
    return R.knn(vectors(t), query_vectors(t), 10, 0.2)


@query("knn_lsh")
def _(t: Tables) -> DataFrame:
    return R.lsh_neighbours(vectors(t), query_vectors(t), 10, 64)


def _lists(t: Tables, n: int) -> tuple[DataFrame, DataFrame]:
    """Candidates by lists and codes, and the neighbours from them: three quarters of the lists are looked into, at most 8 % of the vectors are scored."""
    corpus, size = vectors(t), t.embeddings.count()
    books = V.train(corpus)
    found = stages.written(V.candidates(V.build_lists(corpus, books), query_vectors(t), books, probes=max(1, len(books.centres) * 3 // 4), refine=min(25 * n, max(n, size * 8 // 100))), "candidates")
    return found, V.neighbours(corpus, query_vectors(t), found, n)


@query("knn_ivf")
def _(t: Tables) -> DataFrame:
    return _lists(t, 10)[1]


@query("knn_ivf_report")
def _(t: Tables) -> DataFrame:
    """Recall against the exact search, and the share of all pairs that were scored exactly."""
    found, best = _lists(t, 10)
    exact = R.knn(vectors(t), query_vectors(t), 10).select("query_id", "id")
    hits = exact.join(best.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
    pairs = t.embeddings.agg((F.count("*") * F.count_if(F.col("vec_id") % 50 == 0)).alias("pairs"))  # one row each
    return hits.join(found.agg(F.count("*").alias("scored"))).join(pairs).select("recall", F.round(F.col("scored") / F.col("pairs"), 4).alias("scored_share"))


_TWO = f"""{_KNN}, b AS (SELECT *, 1 AS pass_no FROM {_top('k', 6, 'WHERE label IN (0, 1)')} UNION ALL SELECT *, 2 FROM {_top('k', 12)}), m AS (SELECT query_id, id, min(pass_no) AS pass_no, arg_min(rank, pass_no) AS pr, arg_min(similarity, pass_no) AS similarity FROM b WHERE similarity >= 0.1 GROUP BY ALL),
two AS (SELECT query_id, id, pass_no, similarity, row_number() OVER (PARTITION BY query_id ORDER BY pass_no, pr, id)::INT AS rank FROM m)"""


def _two(t: Tables) -> DataFrame:
    return R.two_pass(vectors(t), query_vectors(t), F.col("label").isin(0, 1), 4, 0.1)


@query("dense_two_pass", f"WITH {_TWO} SELECT * FROM two")
def _(t: Tables) -> DataFrame:
    return _two(t)


_RRF = f"WITH {_TWO}, {_bm25_sql(8)}, u AS (SELECT query_id // 50 AS query_id, id, 1.0::DOUBLE / (60 + rank) AS s, 0 AS list_no FROM two UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank), 1 FROM bm), g AS (SELECT query_id, id, round(sum(s), 9) AS score, min(list_no) AS list_no FROM u GROUP BY ALL), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_no, id)::INT AS rank FROM g)"


def _dense(t: Tables) -> DataFrame:
    """The dense lists of the benchmark's items: the vector with 50 times an item's id stands for it."""
    return _two(t).withColumn("query_id", F.floor(F.col("query_id") / 50))


def _fused(t: Tables) -> DataFrame:
    return R.rrf([_dense(t), R.bm25(corpus(t), asked(t), 8)])


@query("rrf_fuse", f"{_RRF} SELECT query_id, id, score, list_no, rank FROM fused")
def _(t: Tables) -> DataFrame:
    return _fused(t).select("query_id", "id", "score", "list_no", "rank")


def _overlap_sql(q: str, p: str) -> str:
    q = f"list_distinct({_TOK.format(t=q)})"
    return f"round(len(list_intersect({q}, list_distinct({_TOK.format(t=f'({p})[1:2000]')}))) / greatest(len({q}), 1), 6)"


@query("rerank_topn", f"""WITH {_bm25_sql(8)}, r AS (SELECT bm.query_id, bm.id, bm.score, bm.rank AS given, {_overlap_sql('b.text', 'd.text')} AS rerank_score FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id)
SELECT query_id, id, score, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, given, id)::INT AS rank FROM r) WHERE rank <= 3""")
def _(t: Tables) -> DataFrame:
    return R.rerank(R.bm25(corpus(t), asked(t), 8), asked(t), corpus(t), 3).select("query_id", "id", "score", "rerank_score", "rank")


_TYPES = {0: "textbook", 1: "qa_pair", 2: "paper"}


@query("boost_resort", f"""WITH {_TWO}, j AS (SELECT two.query_id, two.id, round(greatest(0, least(1, two.similarity + CASE e.label WHEN 0 THEN 0.15 WHEN 1 THEN 0.10 WHEN 2 THEN -0.03 ELSE 0 END)), 6) AS similarity, rank AS given FROM two JOIN embeddings e ON e.vec_id = two.id)
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, given, id)::INT AS rank FROM j""")
def _(t: Tables) -> DataFrame:
    names = F.create_map(*[x for k, v in _TYPES.items() for x in (F.lit(k), F.lit(v))])
    d = _two(t).join(t.embeddings.select(F.col("vec_id").alias("id"), F.try_element_at(names, F.col("label")).alias("kind")), "id")
    return R.boost(d, F.coalesce("kind", F.lit("")), "similarity").select("query_id", "id", "similarity", "rank")


def hybrid(t: Tables, queries: DataFrame, fusion: str = "union", n: int = 6) -> DataFrame:
    """Dense, then lexical, fused, re-ranked on the texts, boosted by source type.

    ``queries``: query_id, text. Queries in Arabic script get no lexical rows. ``fusion="disjoint"`` takes lexical rows the dense list already has out before the fusion.
    """
    dense, lexical = _dense(t), R.bm25(corpus(t), queries.where(X.script_language(F.col("text")) == "en"), 8)
    if fusion == "disjoint":
        lexical = lexical.join(dense.select("query_id", "id"), ["query_id", "id"], "left_anti")
    best = R.rerank(R.rrf([dense, lexical]).drop("list_no"), queries, corpus(t), n)
    d = best.join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id")
    kind = F.when(F.col("source") == "src0", "textbook").when(F.col("source") == "src1", "paper").otherwise("")
    return R.boost(d, kind, "rerank_score").select("query_id", "id", "rerank_score", "rank")


_HYBRID = f"""{_RRF}, r AS (SELECT f.query_id, f.id, f.rank AS given0, {_overlap_sql('b.text', 'd.text')} AS s, d.source FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, given0, id) AS given FROM r) WHERE given <= 6), v AS (SELECT query_id, id, given, round(greatest(0, least(1, s + CASE source WHEN 'src0' THEN 0.15 WHEN 'src1' THEN -0.03 ELSE 0 END)), 6)::DOUBLE AS rerank_score FROM t),
hybrid AS (SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, given, id)::INT AS rank FROM v)"""


@query("hybrid_retrieve", f"{_HYBRID} SELECT * FROM hybrid")
def _(t: Tables) -> DataFrame:
    return hybrid(t, asked(t))


_GLOSSARY = {"than": "that", "que": "qui"}
_EXPANDED = """asked AS (SELECT item_id, text || CASE WHEN len(found) > 0 THEN ' (' || array_to_string(found, ', ') || ')' ELSE '' END AS text,
CASE WHEN regexp_matches(text[1:50], '[\u0600-\u06FF]') THEN 'fa' ELSE 'en' END AS language FROM (SELECT *, list_filter([CASE WHEN contains(lower(text), 'than') THEN 'that' END, CASE WHEN contains(lower(text), 'que') THEN 'qui' END], lambda x: x IS NOT NULL) AS found FROM benchmark))"""


@query("auto_lang_retrieve", _HYBRID.replace("WITH ", f"WITH {_EXPANDED}, ", 1).replace("JOIN benchmark b", "JOIN asked b").replace("AS term FROM benchmark", "AS term FROM asked") + " SELECT hybrid.*, language FROM hybrid JOIN asked ON item_id = query_id")
def _(t: Tables) -> DataFrame:
    """Language tag and glossary expansion before the hybrid retrieval; no language filter."""
    from ..operators.joins import glossary_matches

    q = glossary_matches(asked(t), "query_id", "text", _GLOSSARY).withColumn("language", X.script_language(F.col("text")))
    return hybrid(t, q.select("query_id", F.col("expanded").alias("text"))).join(q.select("query_id", "language"), "query_id")


_TWO_SCRIPTS = """asked AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'دمای شیشه ' ELSE '' END || text AS text, item_id % 3 > 0 AS english FROM benchmark)"""


@query("hybrid_two_scripts", _HYBRID.replace("WITH ", f"WITH {_TWO_SCRIPTS}, ", 1).replace("JOIN benchmark b", "JOIN asked b").replace("AS term FROM benchmark", "AS term FROM asked WHERE english") + " SELECT * FROM hybrid")
def _(t: Tables) -> DataFrame:
    """A third of the queries begins in Arabic script: dense rows only for these."""
    return hybrid(t, asked(t).withColumn("text", F.concat(F.when(F.col("query_id") % 3 == 0, "دمای شیشه ").otherwise(""), "text")))


@query("context_pack", f"""WITH {_bm25_sql(8)}, pc AS (SELECT bm.query_id, bm.rank, CASE WHEN bm.rank > 3 AND bm.score < 25 THEN d.text[1:500] ELSE d.text[1:1000] END AS piece FROM bm JOIN documents d ON d.doc_id = bm.id),
u AS (SELECT *, 60 + sum(length(piece)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM pc), st AS (SELECT *, min(CASE WHEN rank > 3 AND used > 5000 THEN rank END) OVER (PARTITION BY query_id) AS stop FROM u)
SELECT query_id, count(*) AS n_chunks, string_agg(piece, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM st WHERE stop IS NULL OR rank < stop GROUP BY query_id""")
def _(t: Tables) -> DataFrame:
    d = R.bm25(corpus(t), asked(t), 8).join(corpus(t).select("id", "text"), "id")
    return R.pack_context(d, "text", "score", budget=5000, weak=25.0)


@query("context_format", f"""WITH {_bm25_sql(3)} SELECT bm.query_id, string_agg('[' || bm.rank || '] ' || d.source || ' (' || d.lang || ')' || chr(10) || d.text[1:300], chr(10) ORDER BY bm.rank) AS block FROM bm JOIN documents d ON d.doc_id = bm.id GROUP BY bm.query_id""")
def _(t: Tables) -> DataFrame:
    d = R.bm25(corpus(t), asked(t), 3).join(corpus(t), "id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(" ("), "lang", F.lit(")\n"), F.substring("text", 1, 300))
    d = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return d.select("query_id", F.array_join("l.line", "\n").alias("block"))


@query("retrieval_eval", f"""WITH {_TWO}, q AS (SELECT query_id, count(*) AS n, max(similarity) AS best, avg(similarity) AS mean, count(*) FILTER (WHERE pass_no = 1) AS priority FROM two GROUP BY query_id)
SELECT count(*) AS queries, round(avg(best), 4) AS top_similarity, round(avg(mean), 4) AS avg_similarity, sum(n)::BIGINT AS chunks, sum(priority)::BIGINT AS priority, count(*) FILTER (WHERE mean >= 0.5) AS good, count(*) FILTER (WHERE mean < 0.5) AS weak FROM q""")
def _(t: Tables) -> DataFrame:
    q = _two(t).groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("best"), F.avg("similarity").alias("mean"), F.count_if(F.col("pass_no") == 1).alias("priority"))
    return q.agg(F.count("*").alias("queries"), F.round(F.avg("best"), 4).alias("top_similarity"), F.round(F.avg("mean"), 4).alias("avg_similarity"), F.sum("n").alias("chunks"), F.sum("priority").alias("priority"), F.count_if(F.col("mean") >= 0.5).alias("good"), F.count_if(F.col("mean") < 0.5).alias("weak"))


@query("grounded_sets", f"WITH {_KNN} SELECT query_id, count(*) AS sources, round(avg(similarity), 6) AS mean_similarity FROM {_top('k', 5)} WHERE similarity > 0.3 GROUP BY query_id HAVING count(*) >= 2")
def _(t: Tables) -> DataFrame:
    d = R.knn(vectors(t), query_vectors(t), 5, 0.3).groupBy("query_id").agg(F.count("*").alias("sources"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))
    return d.where("sources >= 2")


_PREFIX = "list_transform(embedding[1:16], lambda x: x::DOUBLE / sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])))"


@query("semantic_match", f"""WITH p AS (SELECT vec_id, label, {_PREFIX} AS v FROM embeddings), m AS (SELECT a.vec_id, b.vec_id AS cached, round(list_dot_product(a.v, b.v), 6) AS similarity FROM p a JOIN p b ON a.label = b.label AND b.vec_id % 50 <> 0 WHERE a.vec_id % 50 = 0)
SELECT vec_id, cached, similarity, similarity >= 0.92 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, cached) AS r FROM m) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    p = t.embeddings.select("vec_id", "label", R.l2_normalise(F.col("embedding"), 16).alias("v"))
    a, b = p.where("vec_id % 50 = 0"), p.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("cached"), "label", F.col("v").alias("w"))
    m = a.join(b, "label").select("vec_id", "cached", F.round(R.dot(F.col("v"), F.col("w")), 6).alias("similarity"))
    return R.top(m, ["vec_id"], [F.desc("similarity"), F.col("cached")], 1).select("vec_id", "cached", "similarity", (F.col("similarity") >= 0.92).alias("hit"))


@query("l2_normalise", f"SELECT vec_id, round(list_sum({_PREFIX}), 5) AS total, round({_PREFIX}[1], 5) AS first FROM embeddings")
def _(t: Tables) -> DataFrame:
    d = t.embeddings.select("vec_id", R.l2_normalise(F.col("embedding"), 16).alias("v"))
    return d.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.col("v")[0], 5).alias("first"))


@query("query_dedup", "SELECT item_id, min(item_id) OVER (PARTITION BY md5(text || '|8|en|')) AS runs_as FROM (SELECT * FROM benchmark UNION ALL SELECT item_id + 1000000, text FROM benchmark WHERE item_id % 5 = 0)")
def _(t: Tables) -> DataFrame:
    """Each question with the first that has the same text and parameters; every fifth is asked twice."""
    again = t.benchmark.where("item_id % 5 = 0").withColumn("item_id", F.col("item_id") + 1000000)
    return R.same_questions(t.benchmark.unionByName(again), "item_id", F.col("text"), F.lit(8), F.lit("en"), F.lit(""))


@query("kw_coverage", r"""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: length(x) > 3)) AS r, list_distinct(regexp_split_to_array(lower(d.text), '\s+')) AS a FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, round(CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(r, a)) / len(r) END, 6) AS coverage FROM d""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % t.benchmark.count()).alias("item_id")).join(t.benchmark.select("item_id", F.col("text").alias("r")), "item_id")
    return d.select("doc_id", F.round(X.keyword_coverage(F.col("text"), F.col("r")), 6).alias("coverage"))


@query("kw_overlap", r"""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: length(x) > 3)) AS r, lower(d.text) AS a FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, round(CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_filter(r, lambda x: contains(a, x))) / len(r) END, 6) AS overlap FROM d""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % t.benchmark.count()).alias("item_id")).join(t.benchmark.select("item_id", F.col("text").alias("r")), "item_id")
    return d.select("doc_id", F.round(X.keyword_overlap(F.col("text"), F.col("r")), 6).alias("overlap"))


@query("vectorise")
def _(t: Tables) -> DataFrame:
    """Hashed term weights as unit vectors, when no encoder is supplied."""
    return R.vectorise(t.documents, "doc_id", "text").select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))
