"""Report parsing on odd texts against plain versions of its rules, and the forms of wide rows."""

import re

import duckdb
from pyspark.sql import functions as F

from siftmill.functions import reports as P
from siftmill.operators import wide_rows as W

TEXTS = [
    None, "", "Composition", "Composition 1: SiO2: 72%, Na2O = 14wt%, SiO2: 70.\nOption: none here\ncandidate 2:\n K2O:3% Composition 4: B2O3: 9 DESIGN RATIONALE CaO: 5",
    "ROOT CAUSES:\n1. Uneven cooling - HIGH\n  along the\n\n  edge\n2. tiny\n- Seeds in the low melt - medium\n\n4. too late", "root cause " + "x" * 300 + "\n* " + "y " * 400 + "\n" + "z " * 400,
    "Corrective actions: now then, at once immediate\n\nCOMPOSITION 9 : Fe2O3 : 1 : 2", "CORRECTIVE ACTION\n" + "".join(f"{i}) Keep the furnace at {i} degrees - long-term\nbetter\n" for i in range(9)),
]


def plain_compositions(text):
    blocks = re.findall(rf"{P.CANDIDATE}[:\s]+(.*?)(?={P.CANDIDATE}[:\s]|{P.RATIONALE}|$)", text, re.I | re.S)[:3]
    found = [{k: float(v) for k, v in re.findall(P.COMPONENT, b)} for b in blocks]
    return [f for f in found if f]


def plain_items(text, heading, stop, marks, most, rate, usual, length):
    section, out = re.search(rf"{heading}[:\s]*(.*?)(?:\n\n{stop}|\Z)", text, re.I | re.S), []
    for item in map(str.strip, re.split(P.ITEM, section.group(1)) if section else []):
        line, *rest = item.split("\n")
        line, more = re.sub(rf"\s*[-–]\s*({marks})\s*$", "", line.strip(), flags=re.I).strip(), " ".join(x.strip() for x in rest if x.strip())
        if len(item) >= 15 and line:
            out.append((line[:length], rate(item), more[: 500 if usual is None else 300] or (line if usual is None else usual)))
    return out[:most]


def test_reports_by_plain_rules(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    text = F.col("text")
    got = d.select("i", P.compositions(text).alias("c"), P.root_causes(text).alias("r"), P.corrective_actions(text).alias("a")).orderBy("i").collect()
    named = lambda *pairs: lambda s: next((n for p, n in pairs if re.search(rf"\b{p}\b", s, re.I)), "medium" if pairs[0][0] == "HIGH" else "short-term")
    for row, said in zip(got, TEXTS):
        said = said or ""
        assert list(row["c"] or []) == plain_compositions(said)
        assert [tuple(x) for x in row["r"] or []] == plain_items(said, "ROOT CAUSES?", "[A-Z3-9]", "HIGH|MEDIUM|LOW", 5, named(("HIGH", "high"), ("LOW", "low")), None, 200)
        assert [tuple(x) for x in row["a"] or []] == plain_items(said, "CORRECTIVE ACTIONS?", "[A-Z]", "IMMEDIATE|SHORT.TERM|LONG.TERM", 6, named(("IMMEDIATE", "immediate"), ("LONG.TERM", "long-term")), "Defect reduction/elimination", 300)
    assert d.limit(0).select(P.compositions(text)).count() == 0


def test_numbers_as_in_text(spark):
    values = [0.0, 1.0, 2.5, 1234.0, 12345.0, 99999.0, 0.00012345, 0.000012, 1e20, -3.14159, 100.0, 0.1]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", W.significant(F.col("x")).alias("s")).collect()
    assert all(r["s"] == (f"{r['x'] * (1 + 1e-12):.4g}" if r["x"] else "0") for r in got), got


def test_wide_rows_with_blanks_and_no_cells(spark):
    d = spark.createDataFrame([(1, None, " ", None), (2, "0", "x", "12345.0"), (3, "-1", None, None), (4, "7.126", "0", "1 m")], "key int, comp_a_b string, comp_c string, t_x string")
    names = W.readable_names(spark.createDataFrame([("T_X", "Heat", "C"), ("comp_zz", "no", None), (None, "a", "b")], "field string, name string, unit string"), d.columns)
    assert names == {"t_x": "Heat (C)"}
    rows = W.described(d, names)
    text = {r["key"]: r["t"] for r in rows.select("key", W.row_text(F.col("key")).alias("t")).collect()}
    assert text == {1: None, 2: "Glass #2 — Composition: C: x — Properties: Heat (C)=1.235e+04", 3: None, 4: "Glass #4 — Composition: AB: 7.13% — Properties: Heat (C)=1 m"}
    made = W.row_examples(rows, "key", ["{key}?"], ["{component} {value} {system}"], "book", "s").collect()
    assert {r["key"] for r in made} == {2, 4} and all(r["question"] == "AB 7.1 AB" for r in made if r["n"] == 1)
    assert sorted(tuple(r) for r in W.long_form(d, "key", d.columns[1:]).where("key = 4").collect()) == [(4, "comp_a_b", "7.126"), (4, "comp_c", "0"), (4, "t_x", "1 m")]


def test_reports_are_dealt_over_all_tasks(spark, sf):
    from siftmill.plans.registry import Tables
    from siftmill.plans.reports import reports

    t = Tables(spark, sf)
    assert t.part.rdd.getNumPartitions() == 1
    held = reports(t).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 4 and sum(r["count"] for r in held) == t.part.count()


def test_wide_rows_keep_ties_odd_numbers_and_plain_doubles(spark):
    cells = [(1, 0.005, 2.675, 12345.0), (2, 1e23, float("nan"), 1.2345), (3, -1.0, 0.0, -12345.0), (4, float("inf"), 0.125, 1e-7), (None, 7.0, None, None)]
    d = spark.createDataFrame(cells, "key int, comp_a double, comp_b double, t_x double")
    as_text = d.select("key", *[F.col(c).cast("string").alias(c) for c in d.columns[1:]])
    rows = W.described(d, {}, keep=["key"])
    assert rows.columns == ["key", "parts", "part_text", "values", "value_text"]
    said = {r["key"]: (r["part_text"], r["value_text"]) for r in rows.collect()}
    assert said == {1: ("A: 0.01%, B: 2.68%", "t_x=1.235e+04"), 2: ("A: 100000000000000000000000.00%, B: NaN%", "t_x=1.235"), 3: ("", "t_x=-1.235e+04"), 4: ("A: Infinity%, B: 0.13%", "t_x=1e-07"), None: ("A: 7.00%", "")}
    assert {r["key"]: (r["part_text"], r["value_text"]) for r in W.described(as_text, {}).collect()} == said
    few = W.described(d.where("key = 1"), {}, most_parts=1).head()
    assert few["part_text"] == "A: 0.01%" and len(few["parts"]) == 2
    made = W.row_examples(rows, "key", ["{key}?"], ["{component} {value} {system}"], "book", "s").collect()
    assert {r["key"] for r in made} == {1, 2, 3, 4, None} and all(r["question"] is None for r in made if r["key"] is None)


def test_wide_rows_run_no_lambda_a_row(spark):
    d = spark.createDataFrame([(1, 2.0, "x")], "key int, comp_a double, t_x string")
    plan = W.row_examples(W.described(d, {}), "key", ["{key}?"], ["{component}"], "book", "s")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "format_string" not in plan


def test_all_root_causes_of_a_report_are_parsed(spark, tmp_path):
    from siftmill import plans

    part = spark.createDataFrame([(1, "a name " * 40, "Brand#1", "TYPE " * 150, 47)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((tuple(r) for r in plans.QUERIES["parse_root_causes"](spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == list(range(1, len(got) + 1)) and len(got) == 9  # four and five more
    assert len(got[0][2]) > 250 and len(got[0][4]) > 700  # neither cause nor explanation is cut
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(plans.ORACLE_SQL["parse_root_causes"]).fetchall(), key=lambda r: r[1])
