"""Structured reports and wide rows: parsing to nested columns, request texts, and examples from sparse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reports as P
from ..operators import wide_rows as W
from ..sources import stages
from .registry import Tables, query

#: A report on each part, as SQL that Spark and DuckDB read alike.
_REPORT = """'1. SUGGESTED COMPOSITIONS' || chr(10) || 'Composition 1: SiO2: ' || (p_partkey % 60 + 20) || '%, Na2O = ' || (p_partkey % 7) || '.5 wt%, SiO2: ' || (p_partkey % 97) || '.25%' || chr(10)
|| 'option: ' || p_name || chr(10) || 'Candidate 3 Al2O3: ' || p_size || chr(10) || 'Option 4: B2O3: 12%' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Composition 5: K2O: 1%' ELSE '' END
|| CASE WHEN p_partkey % 4 = 0 THEN chr(10) || 'Design Rationale: CaO: 9%' ELSE '' END || chr(10) || 'Tg: ' || (400 + p_size) || CASE WHEN p_partkey % 2 = 0 THEN '-' || (500 + p_size) ELSE '' END || ' °C, Density: ~ 2.' || p_size || ' g/cm3'
|| CASE WHEN p_partkey % 5 = 0 THEN ' CTE: 8.5–9.1 ×10-7 Refractive index: 1.5' || p_size ELSE '' END || chr(10) || chr(10)
|| CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'Root causes:' || chr(10) || '1. The ' || p_name || ' was cooled too fast - ' || CASE p_size % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'LOW' ELSE 'Medium' END || chr(10) || '   ' || p_type || ' parts suffer' || chr(10) || '   at size ' || p_size || chr(10)
|| '2) short one' || chr(10) || '- Highly uneven heat in ' || p_brand || chr(10) || '* The highest risk is low: low - high' || chr(10) || '3. ' || p_brand || ' has a feeder block' || repeat(' that is worn', p_size) || chr(10) || repeat('4. One more cause of many' || chr(10), p_size % 6) END || chr(10)
|| CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'CORRECTIVE ACTION: replace ' || p_name || ' - Immediate' || chr(10) || 'fewer stones' || chr(10) || '2. Plan a furnace for ' || p_brand || ' long term' || repeat(chr(10) || '- Check the ' || p_type || ' feeder', p_size % 8) || chr(10) || chr(10) || 'End' END"""
_R = f"WITH r AS (SELECT p_partkey, {_REPORT} AS report FROM part)"


def reports(t: Tables) -> DataFrame:
    return stages.spread(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey").select("p_partkey", F.expr(_REPORT).alias("report"))


_BLOCKS = rf"""list_transform(string_split(regexp_replace(report, '(?i)({P.CANDIDATE}[:\s])', chr(1) || '\1', 'g'), chr(1))[2:4], lambda b: regexp_replace(regexp_replace(b, '(?i)^{P.CANDIDATE}[:\s]+', ''), '(?is){P.RATIONALE}.*', ''))"""


@query("parse_compositions", rf"""{_R}, b AS (SELECT p_partkey, {_BLOCKS} AS blocks FROM r),
c AS (SELECT p_partkey, i, unnest(regexp_extract_all(blocks[i], '{P.COMPONENT}', 1)) AS component, unnest(regexp_extract_all(blocks[i], '{P.COMPONENT}', 2)) AS amount, generate_subscripts(regexp_extract_all(blocks[i], '{P.COMPONENT}', 1), 1) AS k FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM b)),
d AS (SELECT p_partkey, i, component, arg_max(amount, k)::DOUBLE AS amount FROM c GROUP BY ALL)
SELECT p_partkey, (dense_rank() OVER (PARTITION BY p_partkey ORDER BY i) - 1)::INT AS candidate, component, amount FROM d""")
def _(t: Tables) -> DataFrame:
    d = reports(t).select("p_partkey", F.posexplode(P.compositions(F.col("report"))).alias("candidate", "m"))
    return d.select("p_partkey", "candidate", F.explode("m").alias("component", "amount"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _twin(heading: str, stop: str, marks: str, most: int | None = None) -> str:
    """DuckDB: the items of a section, a row each, numbered in order."""
    item, line, rest = _STRIP.format("x"), _STRIP.format(f"regexp_replace({_STRIP.format('string_split(x, chr(10))[1]')}, '(?i)\\s*[-–]\\s*({marks})\\s*$', '')"), f"array_to_string(list_filter(list_transform(string_split(x, chr(10))[2:], lambda y: {_STRIP.format('y')}), lambda y: y <> ''), ' ')"
    return rf"""{_R}, s AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(regexp_extract(report, '(?is){heading}[:\s]*(.*?)(?:\n\n{stop}|\z)', 1), '{P.ITEM}'), lambda x: {item}), lambda x: length(x) >= 15) AS xs FROM r),
e AS (SELECT p_partkey, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM s), f AS (SELECT p_partkey, k, x, {line} AS line, {rest} AS rest FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY k)::INT AS n FROM f WHERE line <> ''{f" QUALIFY n <= {most}" if most else ""})"""


@query("parse_root_causes", _twin("ROOT CAUSES?", "[A-Z3-9]", "HIGH|MEDIUM|LOW") + r""" SELECT p_partkey, n, line AS cause, CASE WHEN regexp_matches(x, '(?i)\bHIGH\b') THEN 'high' WHEN regexp_matches(x, '(?i)\bLOW\b') THEN 'low' ELSE 'medium' END AS likelihood, CASE WHEN rest <> '' THEN rest ELSE line END AS explanation FROM g""")
def _(t: Tables) -> DataFrame:
    d = reports(t).select("p_partkey", F.posexplode(P.root_causes(F.col("report"), None, None, None)).alias("n", "c"))
    return d.select("p_partkey", (F.col("n") + 1).alias("n"), "c.*")


@query("parse_actions", _twin("CORRECTIVE ACTIONS?", "[A-Z]", "IMMEDIATE|SHORT.TERM|LONG.TERM", 6) + r""" SELECT p_partkey, n, line[1:300] AS action, CASE WHEN regexp_matches(x, '(?i)\bIMMEDIATE\b') THEN 'immediate' WHEN regexp_matches(x, '(?i)\bLONG.TERM\b') THEN 'long-term' ELSE 'short-term' END AS priority, CASE WHEN rest <> '' THEN rest[1:300] ELSE 'Defect reduction/elimination' END AS expected_outcome FROM g""")
def _(t: Tables) -> DataFrame:
    d = reports(t).select("p_partkey", F.posexplode(P.corrective_actions(F.col("report"))).alias("n", "a"))
    return d.select("p_partkey", (F.col("n") + 1).alias("n"), "a.*")


_CUT = "CASE WHEN p_partkey % 3 = 1 THEN '' ELSE report END"
_FOUND = " UNION ALL ".join(f"SELECT p_partkey, {i} AS k, '{n}' AS property_name, {_STRIP.format(f"regexp_extract(text, '(?i){p}', 1)")} AS value, '{u}' AS unit, 'medium' AS confidence, 'LLM analysis' AS source FROM w WHERE regexp_matches(text, '(?i){p}')" for i, (p, n, u) in enumerate(P.PROPERTIES))


@query("measured_properties", f"""{_R}, w AS (SELECT p_partkey, {_CUT} AS text, p_partkey % 100 AS silica FROM r), f AS ({_FOUND}),
g AS (SELECT * FROM f UNION ALL SELECT p_partkey, 0, 'Glass Type', CASE WHEN silica > 90 THEN 'Silicate glass' ELSE 'Modified silicate glass' END, NULL, 'high', 'Composition analysis' FROM w WHERE silica > 60 AND p_partkey NOT IN (SELECT p_partkey FROM f))
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY k))::INT AS n, property_name, value, unit, confidence, source FROM g""")
def _(t: Tables) -> DataFrame:
    """A third of the reports is empty, so that the composition decides."""
    composition = F.create_map(F.lit("SiO2"), (F.col("p_partkey") % 100).cast("double"))
    d = reports(t).withColumn("text", F.expr(_CUT)).select("p_partkey", F.posexplode(P.measured(F.col("text"), composition)).alias("n", "p"))
    return d.select("p_partkey", (F.col("n") + 1).alias("n"), "p.*")


@query("request_texts", """SELECT p_partkey, 'glass composition design ' || p_brand || ' ' || p_size || ' price ' || p_retailprice::DECIMAL(12, 1) || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END || ' no ' || p_name || ' cheap' || ' ' || p_type AS design,
p_name || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ' defect at ' || p_brand ELSE '' END || ' root cause corrective action' AS defect,
nullif(concat_ws(' ', CASE WHEN p_size % 3 > 0 THEN 'glass composition SiO2: ' || p_size || '%, Na2O: ' || (p_size % 9) || '%' END, CASE WHEN p_size % 4 > 0 THEN p_name END, CASE WHEN p_size % 5 > 0 THEN 'properties: ' || p_type || ', ' || p_brand END), '') AS analysis FROM part""")
def _(t: Tables) -> DataFrame:
    size, text = F.col("p_size"), lambda c: F.col(c).cast("string")
    targets = F.create_map("p_brand", text("p_size"), F.lit("price"), F.col("p_retailprice").cast("decimal(12,1)").cast("string"))
    design = P.design_request(targets, F.when(size > 25, F.col("p_type")), F.array(F.concat(F.lit("no "), "p_name"), F.lit("cheap"), F.col("p_type"), F.lit("not asked")))
    defect = P.defect_request(F.col("p_name"), F.when(size > 25, F.col("p_type")), F.when(size % 2 == 0, F.col("p_brand")))
    oxides = F.when(size % 3 > 0, F.create_map(F.lit("SiO2"), text("p_size"), F.lit("Na2O"), (size % 9).cast("string")))
    analysis = P.analysis_request(oxides, F.when(size % 4 > 0, F.col("p_name")), F.when(size % 5 > 0, F.array("p_type", "p_brand")))
    return t.part.select("p_partkey", design.alias("design"), defect.alias("defect"), analysis.alias("analysis"))


#: Lines of orders as a sparse wide table, as SQL that Spark and DuckDB read alike.
_WIDE = """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20))) AS id, l_tax AS comp_si_o2, CASE WHEN l_quantity > 9 THEN l_quantity END AS comp_na2o, CASE WHEN l_returnflag = 'A' THEN ' ' ELSE ' ' || l_returnflag END AS comp_rest, l_extendedprice AS prop_price,
CASE WHEN l_linenumber % 2 = 0 THEN l_discount / 1000 END AS t_melt, CASE WHEN l_linenumber = 3 THEN l_linestatus END AS d_state FROM lineitem"""
_NAMES = [("PROP_PRICE", "Price", "EUR"), ("t_melt", "Melting point", "nan"), ("other", "Other", "m")]


def wide(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("lineitem")
    return t.spark.sql(_WIDE)


def described(t: Tables) -> DataFrame:
    d = wide(t)
    return W.described(d, W.readable_names(t.spark.createDataFrame(_NAMES, "field string, name string, unit string"), d.columns), keep=["id"])


_G = "printf('%.4g', {0} * (1 + 1e-12))"  # ties away from zero, as Spark rounds
_ROWS = f"""WITH w AS ({_WIDE}), d AS (SELECT *, concat_ws(', ', CASE WHEN comp_si_o2 > 0 THEN printf('SIO2: %.2f%%', comp_si_o2) END, CASE WHEN comp_na2o > 0 THEN printf('NA2O: %.2f%%', comp_na2o) END, CASE WHEN trim(comp_rest) <> '' THEN 'REST: ' || trim(comp_rest) END) AS part_text,
concat_ws(', ', 'Price (EUR)=' || {_G.format('prop_price')}, 'Melting point=' || {_G.format('t_melt')}, 'd_state=' || d_state) AS value_text FROM w)"""


@query("wide_long", f"""WITH w AS ({_WIDE}) SELECT field, count(*) AS cells, count(DISTINCT value) AS kinds, sum(TRY_CAST(value AS DECIMAL(18, 6)))::DOUBLE AS total
FROM (UNPIVOT (SELECT id, trim(CAST(comp_si_o2 AS VARCHAR)) AS comp_si_o2, trim(CAST(comp_na2o AS VARCHAR)) AS comp_na2o, trim(comp_rest) AS comp_rest, trim(CAST(d_state AS VARCHAR)) AS d_state FROM w) ON comp_si_o2, comp_na2o, comp_rest, d_state INTO NAME field VALUE value) WHERE value <> '' GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    d = W.long_form(wide(t), "id", ["comp_si_o2", "comp_na2o", "comp_rest", "d_state"])
    return d.groupBy("field").agg(F.count("*").alias("cells"), F.count_distinct("value").alias("kinds"), F.sum(F.col("value").try_cast("decimal(18,6)")).cast("double").alias("total"))


@query("wide_row_text", _ROWS + " SELECT id, concat_ws(' — ', 'Glass #' || id, 'Composition: ' || nullif(part_text, ''), 'Properties: ' || nullif(value_text, '')) AS text FROM d")
def _(t: Tables) -> DataFrame:
    return described(t).select("id", W.row_text(F.col("id")).alias("text"))


_ASKED = ("What is the composition of glass #{key}?", "Describe the properties of glass #{key}.", "What are the components and properties of glass #{key}?")
_ABOUT = ("What glass compositions contain {component} at around {value}%?", "Tell me about glasses in the {system} system.")
_PICK = "list_value({})[('0x' || substr(md5(id || '{}'), 1, 8))::BIGINT % {} + 1]"
_quoted = lambda texts: ", ".join(f"'{x}'" for x in texts)


@query("wide_row_examples", _ROWS + f""", s AS (SELECT *, CASE WHEN comp_na2o > 0 AND comp_na2o > comp_si_o2 THEN 'NA2O' ELSE 'SIO2' END AS component, greatest(coalesce(comp_na2o, 0), comp_si_o2) AS amount, CASE WHEN comp_na2o > 5 THEN 'NA2O' ELSE '' END AS system FROM d)
SELECT id, 0 AS n, replace({_PICK.format(_quoted(_ASKED), 'rq', len(_ASKED))}, '{{key}}', id) AS question, 'From the line items:' || chr(10) || chr(10) || concat_ws(' -- ', 'Glass #' || id, 'Composition: ' || nullif(part_text, ''), 'Properties: ' || nullif(value_text, '')) AS answer FROM s
UNION ALL SELECT id, 1, CASE WHEN system <> '' THEN replace(replace(replace({_PICK.format(_quoted(_ABOUT), 'rc', len(_ABOUT))}, '{{component}}', component), '{{value}}', printf('%.1f', amount)), '{{system}}', system) ELSE 'What is known about the composition of glass #' || id || '?' END,
'Glass #' || id || ' from the line items has the following composition: ' || part_text || '.' || CASE WHEN value_text <> '' THEN ' Its measured properties include: ' || value_text || '.' ELSE '' END FROM s WHERE amount > 0 AND ('0x' || substr(md5(id || 'rh'), 1, 8))::BIGINT % 100 < 50""")
def _(t: Tables) -> DataFrame:
    return W.row_examples(described(t), "id", _ASKED, _ABOUT, "line items", "r")
