"""Filters, cleaning, joins and constraint reports over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters, joins
from ..sources import stages
from .registry import Tables, query

VOCABULARY = ["the", "and", "of", "tion", "que"]
_WORDS = r"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> ''))"
W = _WORDS.format(t="text")
def exempt():
    return F.col("source") == "src0"


@query("filter_metadata", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def _(t: Tables) -> DataFrame:
    return filters.by_metadata(t.documents, {"lang": "en"}, {"source": ["src1", "src2"]}).select("doc_id", "lang", "source")


@query("filter_any_keyword", "SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%token%' OR source ILIKE '%license%' OR source ILIKE '%token%'")
def _(t: Tables) -> DataFrame:
    return filters.any_keyword(t.documents, ["license", "token"], ["text", "source"]).select("doc_id")


@query("filter_word_band", f"SELECT doc_id, {W}::INT AS words FROM documents WHERE {W} BETWEEN 20 AND 2000")
def _(t: Tables) -> DataFrame:
    return filters.word_band(t.documents, "text").select("doc_id", X.word_count("text").alias("words"))


@query("filter_relevance", "SELECT doc_id FROM documents WHERE len(list_filter(['the', 'and', 'of', 'tion', 'que'], lambda w: contains(lower(text), w))) >= 2")
def _(t: Tables) -> DataFrame:
    return filters.relevant(t.documents, "text", VOCABULARY).select("doc_id")


_QA = """WITH qa AS (SELECT a.conv_id, a.turn, trim(u.text) AS q, trim(a.text) AS a FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def qa_pairs(t: Tables) -> DataFrame:
    """A user turn and the assistant turn after it."""
    u = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return u.join(t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")), ["conv_id", "turn"])


@query("qa_quality_gate", _QA + r"""
SELECT conv_id, turn, CASE WHEN length(q) < 15 THEN 'question too short' WHEN length(a) < 30 THEN 'answer too short' WHEN length(a) > 4000 THEN 'answer too long'
  WHEN len(list_filter(regexp_split_to_array(a, '\s+'), lambda x: x <> '')) < 5 THEN 'too few words'
  WHEN regexp_matches(lower(a), 'i (don''t|do not|cannot|can''t) know|i''m not sure|no (answer|information|data) (available|found|provided)|^n/?a$|\berror\b|\bexception\b') THEN 'bad pattern' END AS reject_reason FROM qa""")
def _(t: Tables) -> DataFrame:
    return qa_pairs(t).select("conv_id", "turn", filters.qa_reject_reason(F.col("question"), F.col("answer")).alias("reject_reason"))


@query("clean_short", f"SELECT doc_id FROM documents WHERE {W} >= 20 OR source = 'src0'")
def _(t: Tables) -> DataFrame:
    return filters.drop_short(t.documents, "text", exempt()).select("doc_id")


_LETTERS = r"length(regexp_replace(text, '[^a-zA-Z\x{0600}-\x{06FF} ]', '', 'g'))"


@query("clean_alpha_ratio", f"SELECT doc_id, {_LETTERS} AS letters FROM documents WHERE NOT ({_LETTERS} < length(text) * 0.8 AND length(text) > 50) OR source = 'src0'")
def _(t: Tables) -> DataFrame:
    counted = t.documents.select("doc_id", "text", "source", X.n_letters(F.col("text")).alias("letters"))
    return filters.drop_low_letters(counted, "text", exempt(), 0.8, letters="letters").select("doc_id", "letters")


@query("clean_blank", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def _(t: Tables) -> DataFrame:
    return filters.drop_blank(t.documents, "text").select("doc_id")


@query("text_quality", r"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> '')) AS s FROM documents), e AS (SELECT *, list_sum(list_transform(w, lambda x: length(x))) / len(w) AS m FROM d)
SELECT doc_id, round(CASE WHEN length(text) > 100 AND length(text) < 100000 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN m > 3 AND m < 10 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN s > 5 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN contains(lower(text), 'shred') OR contains(lower(text), 'tion') THEN 0.3::DOUBLE ELSE 0 END, 1) AS quality FROM e""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", filters.text_quality(F.col("text"), ["shred", "tion"]).alias("quality"))


@query("flag_degenerate", r"""WITH t AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN text || ' [Source N] and [source n]' WHEN 1 THEN 'This text describes ' || text[1:80] ELSE text END AS text FROM conversations WHERE role = 'assistant'),
a AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM a WHERE len(w) > 20),
l AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, gram FROM g GROUP BY ALL HAVING count(*) >= 5))
SELECT a.conv_id, a.turn, len(w) < 5 OR (length(text) < 50 AND NOT regexp_matches(text, '[.:،]')) OR l.conv_id IS NOT NULL OR len(string_split(lower(text), '[source n]')) > 2 OR len(string_split(lower(text), 'source_type')) > 2
  OR (len(w) < 30 AND regexp_matches(lower(text), 'the text is written|the text is a reference|this text describes|this response is referenced')) AS degenerate FROM a LEFT JOIN l USING (conv_id, turn)""")
def _(t: Tables) -> DataFrame:
    """Answers, some of them with echo marks or put as a comment."""
    said = F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit(" [Source N] and [source n]"))).when(F.col("conv_id") % 5 == 1, F.concat(F.lit("This text describes "), F.substring("text", 1, 80))).otherwise(F.col("text"))
    return filters.degenerate(t.conversations.where("role = 'assistant'").withColumn("text", said), ["conv_id", "turn"], "text").select("conv_id", "turn", "degenerate")


@query("flag_ascii_answer", r"""WITH a AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9.,%-]+$') AND NOT regexp_matches(x, '^[A-Z][a-z]?[0-9]')) AS w FROM conversations)
SELECT conv_id, turn, len(w) >= 5 AND len(list_filter(w, lambda x: regexp_matches(x, '^[\x00-\x7F]+$'))) > len(w) * 0.6 AS mostly_ascii FROM a""")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", filters.mostly_ascii(F.col("text")).alias("mostly_ascii"))


@query("gate_lengths", f"SELECT doc_id, length(text) >= 50 AS chars_50, length(text) >= 100 AS chars_100, length(text) >= 200 AS chars_200, {W} >= 10 AS words_10, {W} >= 30 AS words_30, {W} >= 40 AS words_40 FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *filters.length_gates(F.col("text"), [50, 100, 200], [10, 30, 40]))


@query("filter_weak_topic", "SELECT item_id FROM benchmark WHERE contains(lower(text), 'than') OR contains(lower(text), 'mente')")
def _(t: Tables) -> DataFrame:
    return t.benchmark.where(X.contains_any(F.col("text"), ["than", "mente"])).select("item_id")


@query("filter_array_member", "WITH d AS (SELECT doc_id, list_filter(['the', 'and', 'of', 'tion', 'que'], lambda w: contains(lower(text), w)) AS k FROM documents) SELECT doc_id, array_to_string(k, ',') AS labels FROM d WHERE list_contains(k, 'que') AND list_has_any(k, ['of', 'tion'])")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", X.terms_in(F.col("text"), VOCABULARY).alias("k"))
    return d.where(F.array_contains("k", "que") & F.arrays_overlap("k", F.array(F.lit("of"), F.lit("tion")))).select("doc_id", F.array_join("k", ",").alias("labels"))


@query("dq_constraints", """SELECT 'role' AS rule, count(*) FILTER (WHERE NOT role IN ('user', 'assistant')) AS violations FROM conversations
UNION ALL SELECT 'turn', count(*) FILTER (WHERE NOT turn >= 0) FROM conversations
UNION ALL SELECT 'unique_conv_id_turn', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)
UNION ALL SELECT 'quality', count(*) FILTER (WHERE NOT quality IN (0, 1)) FROM labels""")
def _(t: Tables) -> DataFrame:
    a = filters.violations(t.conversations, {"role": F.col("role").isin("user", "assistant"), "turn": F.col("turn") >= 0}, ["conv_id", "turn"])
    return a.unionByName(filters.violations(t.labels, {"quality": F.col("quality").isin(0, 1)}))


@query("delete_by_title", "SELECT doc_id, source, (SELECT count(*) FROM documents WHERE source = 'src3') AS deleted FROM documents WHERE source <> 'src3'")
def _(t: Tables) -> DataFrame:
    deleted = t.documents.where("source = 'src3'").agg(F.count("*").alias("deleted"))
    return t.documents.where("source <> 'src3'").select("doc_id", "source").join(F.broadcast(deleted))  # one row


@query("source_relevance", """SELECT source, count(*) AS votes, sum(quality)::BIGINT AS relevant, round(sum(quality) * 100.0 / count(*), 1)::DOUBLE AS relevance_pct
FROM labels JOIN documents USING (doc_id) GROUP BY source ORDER BY votes DESC, source LIMIT 10""")
def _(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("votes"), F.sum("quality").alias("relevant"))
    return d.withColumn("relevance_pct", F.round(F.col("relevant") * 100 / F.col("votes"), 1)).orderBy(F.desc("votes"), "source").limit(10)


@query("nested_children", """SELECT o_orderkey, count(l_orderkey) AS n_children, string_agg(CASE WHEN l_orderkey IS NULL THEN '{}' ELSE '{"n":' || l_linenumber || ',"part":' || l_partkey || '}' END, ',' ORDER BY l_linenumber, l_partkey) AS children
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def _(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    child = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"))
    d = d.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_children"), F.array_sort(F.collect_list(child)).alias("c"))
    return d.select("o_orderkey", "n_children", F.array_join(F.transform("c", lambda x: F.to_json(x)), ",").alias("children"))


@query("conditional_left_join", "SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, d.source) ELSE d.source END AS title FROM documents d LEFT JOIN labels l ON d.lang = 'en' AND d.doc_id = l.doc_id")
def _(t: Tables) -> DataFrame:
    d, labels = t.documents.select("doc_id", "lang", "source"), t.labels.select(F.col("doc_id").alias("l_id"), "quality")
    j = d.join(labels, (d["lang"] == "en") & (d["doc_id"] == labels["l_id"]), "left")
    named = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return j.select("doc_id", F.when(F.col("lang") == "en", F.coalesce(named, "source")).otherwise(F.col("source")).alias("title"))


@query("user_activity", """SELECT c_custkey, max(o_orderdate) AS last_active, count(DISTINCT o_orderpriority) AS sessions, count(*) FILTER (WHERE o_orderstatus = 'F') AS fulfilled
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def _(t: Tables) -> DataFrame:
    d = t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey")
    d = d.agg(F.max("o_orderdate").alias("last_active"), F.countDistinct("o_orderpriority").alias("sessions"), F.count_if(F.col("o_orderstatus") == "F").alias("fulfilled"))
    return d.orderBy(F.desc_nulls_last("last_active"), "c_custkey")


_NEAR = """SELECT DISTINCT a.doc_id FROM documents a JOIN documents b ON b.doc_id < a.doc_id AND a.lang = b.lang AND substring(a.text, 1, 200) = substring(b.text, 1, 200)
  AND abs(length(a.text) - length(b.text)) < length(a.text) * 0.05 AND length(a.text) > 50"""


@query("clean_near_dup", f"SELECT doc_id FROM documents WHERE doc_id NOT IN ({_NEAR})")
def _(t: Tables) -> DataFrame:
    gone = joins.near_duplicates(t.documents, "doc_id", "text", ["lang"])
    return t.documents.select("doc_id").join(gone, "doc_id", "left_anti")


@query("dedup_vs_existing", """WITH n AS (SELECT doc_id, md5(lower(trim(text))) AS h FROM documents WHERE source <> 'src0'), o AS (SELECT md5(lower(trim(text))) AS h FROM documents WHERE source = 'src0')
SELECT min(doc_id) AS doc_id FROM n WHERE h NOT IN (SELECT h FROM o) GROUP BY h""")
def _(t: Tables) -> DataFrame:
    new, known = t.documents.where("source <> 'src0'"), t.documents.where("source = 'src0'")
    return joins.not_known(new, known, X.content_hash(F.col("text")), [F.col("doc_id")]).select("doc_id")


@query("resume_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def _(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.resume(t.orders, done, ["o_orderkey"]).select("o_orderkey")


@query("fk_orphans", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(t: Tables) -> DataFrame:
    return joins.orphans(t.labels, t.documents.where("lang = 'en'"), "doc_id").select("doc_id", "quality")


@query("merge_upgrades", f"""WITH o AS (SELECT conv_id, text, {W} AS w FROM conversations WHERE turn = 1), n AS (SELECT conv_id, text AS new, {W} AS nw FROM conversations WHERE turn = 3)
SELECT conv_id, CASE WHEN nw > w THEN new ELSE text END AS text, CASE WHEN nw > w THEN 'upgraded' ELSE 'original' END AS origin, w::INT AS words_before, CASE WHEN nw > w THEN nw ELSE w END::INT AS words_after FROM o LEFT JOIN n USING (conv_id)""")
def _(t: Tables) -> DataFrame:
    return joins.merge_upgrades(t.conversations.where("turn = 1").select("conv_id", "text"), t.conversations.where("turn = 3"), "conv_id", "text")


@query("lookup_dim", "SELECT n_name, coalesce(r_name || ' (' || n_regionkey || ')', n_name) AS label FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    d = t.nation.join(t.region.where("r_regionkey < 4"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return d.select("n_name", F.coalesce(F.concat("r_name", F.lit(" ("), F.col("n_regionkey").cast("string"), F.lit(")")), "n_name").alias("label"))


_GLOSSARY = {"than": "T1", "and": "T2", "ent": "T3", "que": "T4", "os": "T5", "er": "T6", "in": "T7"}


@query("glossary_expand", """WITH b AS (SELECT item_id, text, list_filter([['than','T1'],['and','T2'],['ent','T3'],['que','T4'],['os','T5'],['er','T6'],['in','T7']], lambda e: contains(lower(text), e[1]))[1:5] AS h FROM benchmark)
SELECT item_id, CASE WHEN len(h) > 0 THEN text || ' (' || array_to_string(list_transform(h, lambda e: e[2]), ', ') || ')' ELSE text END AS expanded FROM b""")
def _(t: Tables) -> DataFrame:
    return joins.glossary_matches(t.benchmark, "item_id", "text", _GLOSSARY).select("item_id", "expanded")


@query("clean_exact_dup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text), lang")
def _(t: Tables) -> DataFrame:
    return joins.keep_first(t.documents, [F.md5("text"), F.col("lang")], [F.col("doc_id")]).select("doc_id")


@query("filter_funnel", f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {W} < 20 THEN 'short' WHEN {W} > 2000 THEN 'long' WHEN len(list_filter(['the', 'and', 'of', 'tion', 'que'], lambda w: contains(lower(text), w))) < 2 THEN 'irrelevant'
  WHEN row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'accepted' END AS reason FROM documents) GROUP BY reason""")
def _(t: Tables) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(X.content_hash(F.col("text"))).orderBy("doc_id"))
    n = X.word_count("text")
    reason = F.when(n < 20, "short").when(n > 2000, "long").when(F.size(X.terms_in(F.col("text"), VOCABULARY)) < 2, "irrelevant").when(nth > 1, "duplicate").otherwise("accepted")
    return t.documents.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("cleanup_pipeline", f"""WITH a AS (SELECT * FROM documents WHERE {W} >= 20 OR source = 'src0'), b AS (SELECT * FROM a WHERE NOT ({_LETTERS} < length(text) * 0.5 AND length(text) > 50) OR source = 'src0'),
c AS (SELECT * FROM b WHERE doc_id IN (SELECT min(doc_id) FROM b GROUP BY md5(text), lang)), d AS (SELECT * FROM c WHERE doc_id NOT IN ({_NEAR.replace('documents a', 'c a').replace('documents b', 'c b')})), e AS (SELECT * FROM d WHERE text IS NOT NULL AND trim(text) <> '')
SELECT 0 AS step, 'all' AS name, count(*) AS rows_left FROM documents UNION ALL SELECT 1, 'short', count(*) FROM a UNION ALL SELECT 2, 'letters', count(*) FROM b UNION ALL SELECT 3, 'exact', count(*) FROM c
UNION ALL SELECT 4, 'near', count(*) FROM d UNION ALL SELECT 5, 'blank', count(*) FROM e""")
def _(t: Tables) -> DataFrame:
    """Rows left after each step; two scans of the documents, as the first rules are counted together, and so are the last."""
    a = filters.long_enough("text") | exempt()
    b = a & (filters.enough_letters("text") | exempt())
    first = t.documents.agg(F.count("*").alias("all"), F.count_if(a).alias("short"), F.count_if(b).alias("letters"))
    c = joins.keep_first(t.documents.where(b), [F.md5("text"), F.col("lang")], [F.col("doc_id")])
    c = stages.written(c.select("doc_id", "lang", F.length("text").alias("n"), F.substring("text", 1, 200).alias("start"), (F.trim("text") == "").alias("blank")), "cleanup")
    near = joins.near_duplicates(c, "doc_id", "start", ["lang"], length=F.col("n")).withColumn("near", F.lit(True))
    marked = c.join(near, "doc_id", "left").select(F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("blank", F.lit(True)).alias("blank"))
    last = marked.agg(F.count("*").alias("exact"), F.count_if(~F.col("near")).alias("near"), F.count_if(~F.col("near") & ~F.col("blank")).alias("blank"))
    steps = ("all", "short", "letters", "exact", "near", "blank")
    one = first.join(F.broadcast(last))  # one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.col(n).alias("rows_left")) for k, n in enumerate(steps)])))
