"""Text, map, JSON and vector expressions, chunking by expression, and training-set jobs over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.history import clean_history
from ..operators import dataset as D
from .history import CLEANED, DRESSED, dressed
from .registry import Tables, query

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
CATEGORIES = {"law": ["license", "copyright"], "code": ["token", "api"], "english": [" the ", " and "], "french": [" que ", " les "], "german": [" und ", " der "]}


@query("clean_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n\d+\n', chr(10), 'g'), '\n- \d+ -\n', chr(10), 'g'), '\n[A-Z\s]{10,}\n', chr(10), 'g'), 'https?://[!$-_a-z]+', '', 'g'), '\S+@\S+', '', 'g'),
 '[^\p{L}\p{N}_\s\p{Z}.,;:!?()\[\]{}''"°%$€£¥/\\-]', ' ', 'g'), '[\s\p{Z}]+([.,;:!?])', '\1', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_text(F.col("text")).alias("text"))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^\d+$') AND NOT regexp_matches(lower(x), '^(page|p\.)\s*\d+'))"


@query("clean_page_lines", f"SELECT doc_id, array_to_string({_LINES}, chr(10)) AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_page_lines(F.col("text")).alias("text"))


@query("lang_tag", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text[1:50], '[\x{0600}-\x{06FF}]') THEN 'fa' ELSE 'en' END AS language FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.script_language(F.col("text")).alias("language"))


_SENTENCES = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')"


@query("sentences", f"SELECT doc_id, (unnest(range(1, len(s) + 1)) - 1)::INT AS place, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("place", "sentence"))


@query("chunk_words", f"""SELECT doc_id, k::INT AS chunk, array_to_string(w[k * 350 + 1 : k * 350 + 400], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 350 + 1)) AS k FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0) WHERE len(w[k * 350 + 1 : k * 350 + 400]) >= 30""")
def _(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", X.tokens("text").alias("w")).where(F.size("w") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(350)), lambda i: F.slice(F.col("w"), i + 1, F.lit(400)))
    return w.select("doc_id", F.posexplode(pieces).alias("chunk", "p")).where(F.size("p") >= 30).select("doc_id", "chunk", F.array_join("p", " ").alias("text"))


@query("sections", r"""WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS n, trim(unnest(s)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
h AS (SELECT *, regexp_matches(line, '^\S+( \S+){0,3}\.?$') AND line <> '' AS heading FROM l), s AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, coalesce(max(CASE WHEN heading THEN line END), 'Introduction') AS title, coalesce(string_agg(CASE WHEN NOT heading THEN line END, chr(10) ORDER BY n), '') AS body FROM s GROUP BY doc_id, section""")
def _(t: Tables) -> DataFrame:
    line = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    line = line.withColumn("heading", F.col("line").rlike(r"^\S+( \S+){0,3}\.?$") & (F.col("line") != ""))
    line = line.withColumn("section", F.sum(F.col("heading").cast("int")).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    s = line.groupBy("doc_id", "section").agg(F.max(F.when(F.col("heading"), F.col("line"))).alias("title"), F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("n", "line")))).alias("b"))
    return s.select("doc_id", "section", F.coalesce("title", F.lit("Introduction")).alias("title"), F.array_join("b.line", "\n").alias("body"))


@query("key_terms", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(['license', 'token', 'the', 'que'], lambda w: contains(lower(text), w)), regexp_extract_all(text, '[A-Z][a-z]?\d')))), ',') AS terms FROM documents")
def _(t: Tables) -> DataFrame:
    found = F.concat(X.terms_in(F.col("text"), ["license", "token", "the", "que"]), F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]?\d)"), 1))
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("terms"))


_CATS = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in CATEGORIES.items())


@query("categories", f"SELECT doc_id, concat_ws(',', {_CATS}) AS labels FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws(",", *[F.when(X.contains_any(F.col("text"), w), F.lit(k)) for k, w in CATEGORIES.items()]).alias("labels"))


@query("doc_metadata", r"""SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 10 AND 200)[1], '') AS title,
list_max(regexp_extract_all(text, '\b((?:19|20)\d\d)\b', 1)) AS year, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS words, length(text)::INT AS chars, (length(text) // 2500)::BIGINT AS pages FROM documents""")
def _(t: Tables) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))  # F.trim itself would take the place of a line as characters to cut
    lines = F.filter(lines, lambda x: F.length(x).between(10, 200))
    years = F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d\d)\b"), 1)
    return t.documents.select("doc_id", F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("title"), F.array_max(years).alias("year"), X.word_count("text").alias("words"), F.length("text").alias("chars"), F.floor(F.length("text") / 2500).alias("pages"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query("query_keywords", rf"""SELECT item_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[.-][A-Za-z0-9]+)*'), lambda w: regexp_matches(w, '^[A-Z][a-z]?\d') OR (NOT list_contains([{_STOP}], lower(w)) AND length(w) > 2)),
lambda w: CASE WHEN regexp_matches(w, '^[A-Z][a-z]?\d') THEN w ELSE lower(w) END), ' ') AS keywords FROM benchmark""")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(X.query_keywords(F.col("text")), " ").alias("keywords"))


@query("smart_truncate", r"""WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents), e AS (SELECT *, length(parts[1]) + length(parts[-1]) + 2 AS ends FROM p),
m AS (SELECT doc_id, i, part, ends + sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM (SELECT doc_id, ends, unnest(parts[2:-2]) AS part, generate_subscripts(parts[2:-2], 1) AS i FROM e WHERE len(parts) > 2)),
k AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY i) AS middle FROM m WHERE used <= 1000 GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text WHEN len(parts) <= 2 OR ends > 1000 THEN regexp_replace(text[1:1000], '\s+\S*\z', '') ELSE concat_ws(chr(10), parts[1], middle, parts[-1]) END AS text FROM e LEFT JOIN k USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.middle_out(F.col("text"), 1000, "\n").alias("text"))


@query("validate_citations", r"""SELECT conv_id, turn, replace(replace(text || ' [Source 1] [Source 9] [منبع ۲] [منبع ۷]', '[Source 9]', ''), '[منبع ۷]', '') AS text FROM conversations""")
def _(t: Tables) -> DataFrame:
    cited = F.concat("text", F.lit(" [Source 1] [Source 9] [منبع ۲] [منبع ۷]"))
    return t.conversations.select("conv_id", "turn", X.validate_citations(cited, 3).alias("text"))


@query("add_citations", f"""SELECT doc_id, array_to_string(list_transform(s, lambda x, i: CASE WHEN i = 1 OR (i = len(s) AND len(s) > 2) OR regexp_matches(x, '[0-9]') THEN x || ' [Source ' || (doc_id % 2 + 1) || ']' ELSE x END), ' ') AS text FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", X.sentences(F.col("text")).alias("s"))
    mark = F.concat(F.lit(" [Source "), (F.col("doc_id") % 2 + 1).cast("string"), F.lit("]"))
    out = F.transform("s", lambda x, i: F.when((i == 0) | ((i == F.size("s") - 1) & (F.size("s") > 2)) | x.rlike("[0-9]"), F.concat(x, mark)).otherwise(x))
    return d.select("doc_id", F.array_join(out, " ").alias("text"))


@query("history_clean", f"SELECT conv_id, turn, {CLEANED} AS text FROM ({DRESSED})")
def _(t: Tables) -> DataFrame:
    return dressed(t).select("conv_id", "turn", clean_history(F.col("text")).alias("text"))


@query("search_snippet", """WITH h AS (SELECT conv_id, turn, text, instr(lower(text), 'tion') AS p FROM conversations WHERE text ILIKE '%tion%'), g AS (SELECT *, greatest(p - 60, 1) AS s FROM h)
SELECT conv_id, turn, CASE WHEN s > 1 THEN '...' ELSE '' END || text[s : p + 63] || CASE WHEN p + 63 < length(text) THEN '...' ELSE '' END AS snippet FROM g ORDER BY conv_id DESC, turn DESC LIMIT 40""")
def _(t: Tables) -> DataFrame:
    d = t.conversations.where(F.col("text").ilike("%tion%")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(40)
    return d.select("conv_id", "turn", X.snippet(F.col("text"), "tion").alias("snippet"))


@query("build_query_text", "SELECT p_partkey, concat_ws(' ', 'composition', p_name, CASE WHEN p_size > 25 THEN 'size ' || p_size END, p_type) AS query FROM part")
def _(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") > 25, F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", F.concat_ws(" ", F.lit("composition"), "p_name", size, "p_type").alias("query"))


@query("classify_first", "SELECT item_id, CASE WHEN contains(lower(text), 'than') OR contains(lower(text), 'thin') THEN 'a' WHEN contains(lower(text), 'que') THEN 'b' ELSE 'other' END AS class FROM benchmark")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.first_match(F.col("text"), [("a", ["than", "thin"]), ("b", ["que"])], "other").alias("class"))


@query("extract_properties", r"SELECT doc_id, regexp_extract(text, '\b(\d+)\s*(words|items|km)\b', 1) AS amount, regexp_extract(text, 'version (\d+(?:\.\d+)?)', 1) AS version, CASE WHEN regexp_matches(text, '[Vv]ersion \d') THEN 'license' ELSE 'none' END AS class FROM documents")
def _(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", F.regexp_extract(text, r"\b(\d+)\s*(words|items|km)\b", 1).alias("amount"), F.regexp_extract(text, r"version (\d+(?:\.\d+)?)", 1).alias("version"), F.when(text.rlike(r"[Vv]ersion \d"), "license").otherwise("none").alias("class"))


@query("section_items", r"""WITH d AS (SELECT doc_id, regexp_extract('Causes:' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- '), '(?is)causes:[^\n]*\n(.*?)(?:\n\s*\n|\z)', 1) AS b FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(trim(x), '^(?:[-*•]|\d+[.)])\s*', ''))), lambda x: length(x) >= 15)[1:5], '|') AS items FROM d""")
def _(t: Tables) -> DataFrame:
    report = F.concat(F.lit("Causes:\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    return t.documents.select("doc_id", F.array_join(X.section_items(report, "causes:", 15, 5), "|").alias("items"))


@query("parse_composition", r'''SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(\w+) = "\w+"', 1))), ',') AS names FROM documents''')
def _(t: Tables) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r'(\w+) = "\w+"'), 1)))
    return t.documents.select("doc_id", F.array_join(names, ",").alias("names"))


@query("extract_items_struct", r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 15)[1:5] AS s FROM documents)
SELECT doc_id, unnest(range(1, len(s) + 1))::INT AS n, unnest(s)[1:40] AS cause, CASE WHEN contains(unnest(s), ' the ') THEN 'HIGH' WHEN contains(unnest(s), ' of ') THEN 'MEDIUM' ELSE 'LOW' END AS likelihood FROM d""")
def _(t: Tables) -> DataFrame:
    lines = F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 15), 1, 5)
    d = t.documents.select("doc_id", F.posexplode(lines).alias("p", "x"))
    rate = F.when(F.col("x").contains(" the "), "HIGH").when(F.col("x").contains(" of "), "MEDIUM").otherwise("LOW")
    return d.select("doc_id", (F.col("p") + 1).alias("n"), F.substring("x", 1, 40).alias("cause"), rate.alias("likelihood"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("map_summary", """SELECT l_orderkey, l_linenumber, l_partkey, ((l_quantity > 0)::INT + (l_extendedprice > 0)::INT + (l_discount > 0)::INT + (l_tax > 0)::INT)::INT AS components,
CASE greatest(l_quantity, l_extendedprice, l_discount, l_tax) WHEN l_extendedprice THEN 'l_extendedprice' WHEN l_quantity THEN 'l_quantity' WHEN l_discount THEN 'l_discount' ELSE 'l_tax' END AS largest FROM lineitem""")
def _(t: Tables) -> DataFrame:
    cells = F.create_map(*[x for c in _MEASURES for x in (F.lit(c), F.col(c))])
    entries = F.transform(F.map_entries(F.map_filter(cells, lambda k, v: v > 0)), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.size(entries).alias("components"), F.array_max(entries)["k"].alias("largest"))


@query("unpivot_text", "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(', ', CASE WHEN l_quantity > 0 THEN 'l_quantity=' || l_quantity::INT END, CASE WHEN l_discount > 0 THEN 'l_discount=' || l_discount END, CASE WHEN l_tax > 0 THEN 'l_tax=' || l_tax END) AS text FROM lineitem")
def _(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("int"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", D.wide_to_text(["l_quantity", "l_discount", "l_tax"], 20).alias("text"))


@query("system_label", "SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_filter([CASE WHEN l_tax > 0.05 THEN 'tax' END, CASE WHEN l_quantity > 0.05 THEN 'qty' END, CASE WHEN l_discount > 0.05 THEN 'disc' END], lambda x: x IS NOT NULL)[1:4]), '-') AS label FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", D.system_label({"tax": "l_tax", "qty": "l_quantity", "disc": "l_discount"}, 0.05, 4).alias("label"))


_PHRASE = r"coalesce(list_filter(list_transform(regexp_split_to_array(text[1:500], '[.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 20 AND 200)[1][1:150], regexp_replace(text[1:100], '^\s+|\s+$', '', 'g'))"


@query("topic_phrase", f"SELECT doc_id, {_PHRASE} AS topic FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", D.topic_phrase(F.col("text")).alias("topic"))


@query("json_merge", """SELECT event_id, json_extract_string(json_merge_patch(props, '{"title": "t"}'), '$.title') AS title, json_extract_string(json_merge_patch(props, '{"title": "t"}'), '$.k') AS k FROM events""")
def _(t: Tables) -> DataFrame:
    fields = lambda c: F.filter(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: e["key"] != "title")
    new = F.array(F.struct(F.lit("title").alias("key"), F.lit("t").alias("value")))
    merged = F.to_json(F.map_from_entries(F.concat(fields("props"), new)))  # the last value of a key stands
    d = t.events.select("event_id", merged.alias("m"))
    return d.select("event_id", F.get_json_object("m", "$.title").alias("title"), F.get_json_object("m", "$.k").alias("k"))


@query("content_normalise", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Question: q' || doc_id || chr(10) || chr(10) || 'Answer: ' || text ELSE text END AS content, CASE doc_id % 3 WHEN 0 THEN 'q' || doc_id WHEN 1 THEN source ELSE text[1:80] END AS title FROM documents")
def _(t: Tables) -> DataFrame:
    from ..sources.readers import normalise_content

    qa = F.to_json(F.struct(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.col("text").alias("answer")))
    line = F.when(F.col("doc_id") % 3 == 0, qa).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("text").alias("content"), "source"))).otherwise(F.to_json(F.struct("text")))
    return normalise_content(t.documents.select("doc_id", line.alias("value")), "value").select("doc_id", "content", "title")


_B = "('0x' || substr(md5({k} || '{s}'), 1, 8))::BIGINT % 100"


@query("union_sources", "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def _(t: Tables) -> DataFrame:
    return D.union_all([t.documents.select(F.col("doc_id").alias("id"), "text", "lang"), t.benchmark.select(F.col("item_id").alias("id"), "text")])


@query("union_dedup", r"""SELECT id, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) ORDER BY source_rank, id) AS r FROM
(SELECT item_id AS id, text, 0 AS source_rank FROM benchmark UNION ALL SELECT doc_id, text, 1 FROM documents)) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    return D.union_distinct([t.benchmark.select(F.col("item_id").alias("id"), "text"), t.documents.select(F.col("doc_id").alias("id"), "text")], "text", "id").select("id", "source_rank")


@query("shuffle_seeded", "SELECT o_orderkey, md5(o_orderkey || 's') AS place FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", D.seeded(F.col("o_orderkey"), "s").alias("place")).repartitionByRange("place").sortWithinPartitions("place")


@query("split_90_10", f"SELECT doc_id, CASE WHEN {_B.format(k='doc_id', s='a')} < 90 THEN 'train' ELSE 'val' END AS split FROM documents")
def _(t: Tables) -> DataFrame:
    return D.ratio_split(t.documents.select("doc_id"), "doc_id", "a", 90)


@query("split_floor", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey || 'b'), o_orderkey) <= (SELECT greatest((count(*) * 0.05)::INT, 100) FROM orders) THEN 'val' ELSE 'train' END AS split FROM orders")
def _(t: Tables) -> DataFrame:
    return D.exact_holdout(t.orders.select("o_orderkey"), "o_orderkey", "b", 0.05, 100)


@query("split_2pct", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey || 'c'), o_orderkey) <= (SELECT greatest((count(*) * 0.02)::INT, 1000) FROM (SELECT DISTINCT l_orderkey FROM lineitem)) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem)")
def _(t: Tables) -> DataFrame:
    return D.exact_holdout(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "c", 0.02, 1000)


@query("cap_source", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || 'd'), doc_id) AS r FROM documents) WHERE r <= CASE source WHEN 'src0' THEN 10 WHEN 'src1' THEN 20 ELSE 40 END")
def _(t: Tables) -> DataFrame:
    return D.cap_groups(t.documents, "source", "doc_id", "d", {"src0": 10, "src1": 20}, 40).select("doc_id", "source")


@query("mix_70_30", f"SELECT doc_id, CASE WHEN {_B.format(k='doc_id', s='e')} < 70 THEN 'with_context' ELSE 'plain' END AS format FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(X.hash_bucket(F.col("doc_id").cast("string"), "e") < 70, "with_context").otherwise("plain").alias("format"))


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || 'f'), doc_id) AS r FROM documents) WHERE r <= 50")
def _(t: Tables) -> DataFrame:
    return D.cap_groups(t.documents, "lang", "doc_id", "f", {"none": 0}, 50).select("doc_id", "lang")


@query("distractor_context", """WITH d AS (SELECT doc_id, md5(doc_id || 'g') AS h, text[1:800] AS t, ('0x' || substr(md5(doc_id || 'g'), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / 4000)::BIGINT) FROM documents) AS b FROM documents),
n AS (SELECT doc_id, list_filter([{'h': h, 't': t}, lead({'h': h, 't': t}, 1) OVER w, lead({'h': h, 't': t}, 2) OVER w, lead({'h': h, 't': t}, 3) OVER w], lambda x: x IS NOT NULL) AS p FROM d WINDOW w AS (PARTITION BY b ORDER BY h, doc_id))
SELECT doc_id, array_to_string(list_transform(list_sort(p), lambda x: x.t), chr(10) || '---' || chr(10))[1:6000] AS context FROM n""")
def _(t: Tables) -> DataFrame:
    return D.distractors(t.documents.select("doc_id", "text"), "doc_id", "text", "g").select("doc_id", "context")


@query("chat_records", f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'Répondez.' ELSE 'Answer.' END || chr(10) || {_PHRASE} || chr(10) || text AS messages FROM documents""")
def _(t: Tables) -> DataFrame:
    record = D.chat_record(F.col("lang"), D.topic_phrase(F.col("text")), F.col("text"), {"fr": "Répondez."}, "Answer.")
    return t.documents.select("doc_id", F.array_join(F.transform(record, lambda m: m["content"]), "\n").alias("messages"))


@query("rag_from_qa", """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p, greatest(1, len(string_split(text, chr(10))) // 2) AS h FROM documents WHERE length(text) >= 50)
SELECT doc_id, '[Source 1]' || chr(10) || array_to_string(p[1:h], chr(10)) || CASE WHEN len(p) > h THEN chr(10) || '[Source 2]' || chr(10) || array_to_string(p[h + 1:], chr(10)) ELSE '' END AS block FROM d""")
def _(t: Tables) -> DataFrame:
    d = t.documents.where(F.length("text") >= 50).select("doc_id", F.split("text", "\n").alias("p"))
    h = F.greatest(F.lit(1), F.floor(F.size("p") / 2).cast("int"))
    second = F.when(F.size("p") > h, F.concat(F.lit("\n[Source 2]\n"), F.array_join(F.slice("p", h + 1, F.size("p")), "\n"))).otherwise("")
    return d.select("doc_id", F.concat(F.lit("[Source 1]\n"), F.array_join(F.slice("p", F.lit(1), h), "\n"), second).alias("block"))


@query("qa_from_chunk", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'What is said about ' WHEN 1 THEN 'Explain ' ELSE 'Describe ' END || {_PHRASE} || '?' AS question, text[1:1500] AS answer FROM documents")
def _(t: Tables) -> DataFrame:
    template = F.element_at(F.array(F.lit("What is said about "), F.lit("Explain "), F.lit("Describe ")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", F.concat(template, D.topic_phrase(F.col("text")), F.lit("?")).alias("question"), F.substring("text", 1, 1500).alias("answer"))


@query("qa_from_row", f"""WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, {_B.format(k='o_orderkey', s='h')} AS b FROM orders) SELECT o_orderkey, 0 AS n, 'Status of order ' || o_orderkey || '?' AS question, o_orderstatus AS answer FROM r
UNION ALL SELECT o_orderkey, 1, 'Priority of order ' || o_orderkey || '?', o_orderpriority FROM r WHERE b < 50""")
def _(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    pair = lambda what, c: F.struct(F.concat(F.lit(f"{what} of order "), key, F.lit("?")).alias("question"), F.col(c).alias("answer"))
    both = F.array(pair("Status", "o_orderstatus"), F.when(X.hash_bucket(key, "h") < 50, pair("Priority", "o_orderpriority")))
    return t.orders.select("o_orderkey", F.posexplode(both).alias("n", "p")).where("p is not null").select("o_orderkey", "n", "p.question", "p.answer")


@query("augment_lineage", "SELECT d.doc_id || '_' || v.kind || '_' || v.n AS id, v.kind AS kind, d.doc_id AS original_id FROM documents d, (VALUES ('para', 0), ('para', 1), ('short', 0)) v(kind, n) WHERE d.doc_id % 10 = v.n")
def _(t: Tables) -> DataFrame:
    variants = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, n in (("para", 0), ("para", 1), ("short", 0))])
    d = t.documents.select("doc_id", F.explode(variants).alias("v")).where(F.col("doc_id") % 10 == F.col("v.n"))
    return d.select(F.concat_ws("_", F.col("doc_id").cast("string"), "v.kind", F.col("v.n").cast("string")).alias("id"), "v.kind", F.col("doc_id").alias("original_id"))
