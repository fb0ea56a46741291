"""Structured reports as nested columns: compositions, rated items, measured values, and request texts for retrieval.

White space, digits and word borders are those of ASCII. Null texts give null or empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What begins a candidate, what ends the last one, and a component with its amount.
CANDIDATE, RATIONALE = r"(?:Composition|Option|Candidate)\s*\d*", "DESIGN RATIONALE"
COMPONENT = r"([A-Z][a-zA-Z0-9]+(?:O\d*)?)\s*[:=]\s*(\d+\.?\d*)\s*(?:wt%|%|)"
ITEM = r"\n\s*(?:\d+[\.\)]\s*|-\s*|\*\s*)"
#: Pattern, name and unit of each measured property.
PROPERTIES = (
    (r"Tg[:\s]+([~≈]?\s*\d+[\-–]\d+|\d+)\s*°?C", "Glass Transition Temperature (Tg)", "°C"),
    (r"CTE[:\s]+([~≈]?\s*\d+\.?\d*[\-–]\d*\.?\d*)\s*(?:×\s*10[-−]?7|ppm)", "Thermal Expansion Coefficient (CTE)", "×10⁻⁷/K"),
    (r"density[:\s]+([~≈]?\s*\d+\.?\d*)\s*g/cm", "Density", "g/cm³"),
    (r"refractive index[:\s]+([~≈]?\s*\d+\.\d+)", "Refractive Index (nd)", ""),
)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def compositions(text: Column, most: int = 3) -> Column:
    """array<map<string,double>>: amounts by component in each of the first ``most`` candidates; a component's last amount counts, candidates without one go."""
    blocks = F.slice(F.regexp_extract_all(text, F.lit(rf"(?is){CANDIDATE}[:\s]+(.*?)(?={CANDIDATE}[:\s]|{RATIONALE}|\z)"), 1), 1, most)

    def amounts(block: Column) -> Column:
        cells = F.arrays_zip(F.regexp_extract_all(block, F.lit(COMPONENT), 1).alias("k"), F.regexp_extract_all(block, F.lit(COMPONENT), 2).alias("v"))
        add = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"].cast("double")))
        return F.aggregate(cells, F.create_map().cast("map<string,double>"), add)

    return F.filter(F.transform(blocks, amounts), lambda m: F.size(m) > 0)


def _items(text: Column, heading: str, stop: str, least: int = 15) -> Column:
    """Items of a section: its first line, and the rest of its lines as one; null without the section."""
    inside = rf"(?is){heading}[:\s]*(.*?)(?:\n\n{stop}|\z)"
    whole = F.filter(F.transform(F.split(F.regexp_extract(text, inside, 1), ITEM), stripped), lambda x: F.length(x) >= least)
    lines = lambda x: F.split(x, "\n")
    rest = lambda x: F.array_join(F.filter(F.transform(F.slice(lines(x), 2, F.size(lines(x))), stripped), lambda y: y != ""), " ")
    return F.when(text.rlike(inside), F.transform(whole, lambda x: F.struct(x.alias("all"), stripped(lines(x)[0]).alias("line"), rest(x).alias("rest"))))


def root_causes(text: Column, most: int | None = 5, cause: int | None = 200, explanation: int | None = 500) -> Column:
    """array<struct<cause,likelihood,explanation>> of the numbered or bulleted causes; medium likelihood where none is named, the cause itself where nothing explains it.

    ``most`` causes, with so many characters of ``cause`` and ``explanation``; with None all of them.
    """
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    line = lambda e: stripped(F.regexp_replace(e["line"], r"(?i)\s*[-–]\s*(HIGH|MEDIUM|LOW)\s*\z", ""))
    rate = lambda e: F.when(e["all"].rlike(r"(?i)\bHIGH\b"), "high").when(e["all"].rlike(r"(?i)\bLOW\b"), "low").otherwise("medium")
    why = lambda e: F.when(e["rest"] != "", cut(e["rest"], explanation)).otherwise(line(e))
    found = F.filter(_items(text, "ROOT CAUSES?", "[A-Z3-9]"), lambda e: line(e) != "")
    causes = F.transform(found, lambda e: F.struct(cut(line(e), cause).alias("cause"), rate(e).alias("likelihood"), why(e).alias("explanation")))
    return causes if most is None else F.slice(causes, 1, most)


def corrective_actions(text: Column, most: int = 6, usual: str = "Defect reduction/elimination") -> Column:
    """array<struct<action,priority,expected_outcome>>; short-term where no other priority is named."""
    line = lambda e: stripped(F.regexp_replace(e["line"], r"(?i)\s*[-–]\s*(IMMEDIATE|SHORT.TERM|LONG.TERM)\s*\z", ""))
    when = lambda e: F.when(e["all"].rlike(r"(?i)\bIMMEDIATE\b"), "immediate").when(e["all"].rlike(r"(?i)\bLONG.TERM\b"), "long-term").otherwise("short-term")
    outcome = lambda e: F.when(e["rest"] != "", F.substring(e["rest"], 1, 300)).otherwise(usual)
    found = F.filter(_items(text, "CORRECTIVE ACTIONS?", "[A-Z]"), lambda e: line(e) != "")
    return F.slice(F.transform(found, lambda e: F.struct(F.substring(line(e), 1, 300).alias("action"), when(e).alias("priority"), outcome(e).alias("expected_outcome"))), 1, most)


def measured(text: Column, composition: Column) -> Column:
    """array<struct<property_name,value,unit,confidence,source>>: the first place of each property; without any, the class of glass by the share of SiO2."""

    def entry(name: Column, value: Column, unit: Column, confidence: str, source: str) -> Column:
        return F.struct(name.alias("property_name"), value.alias("value"), unit.alias("unit"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

    first = lambda p: F.when(text.rlike(f"(?i){p}"), stripped(F.regexp_extract(text, f"(?i){p}", 1)))
    found = F.filter(F.array(*[entry(F.lit(n), first(p), F.lit(u), "medium", "LLM analysis") for p, n, u in PROPERTIES]), lambda e: e["value"].isNotNull())
    silica = F.coalesce(composition["SiO2"], composition["sio2"], F.lit(0.0))
    kind = entry(F.lit("Glass Type"), F.when(silica > 90, "Silicate glass").otherwise("Modified silicate glass"), F.lit(None).cast("string"), "high", "Composition analysis")
    return F.when(F.size(found) > 0, found).when(silica > 60, F.array(kind)).otherwise(F.slice(found, 1, 0))


def _said(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def design_request(targets: Column, base: Column, constraints: Column) -> Column:
    """Retrieval text for target properties (a map of strings), a base system and the first three constraints."""
    wanted = F.array_join(F.transform(F.map_entries(targets), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    return _said(F.lit("glass composition design"), wanted, base, F.array_join(F.slice(constraints, 1, 3), " "))


def defect_request(description: Column, glass: Column, stage: Column) -> Column:
    return _said(description, glass, F.concat(F.lit("defect at "), F.nullif(stage, F.lit(""))), F.lit("root cause corrective action"))


def analysis_request(composition: Column, description: Column, properties: Column) -> Column:
    """Retrieval text for a composition (a map of strings), a description or both; null with nothing to ask."""
    oxides = F.array_join(F.transform(F.map_entries(composition), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("%"))), ", ")
    wanted = F.array_join(properties, ", ")
    full = _said(F.concat(F.lit("glass composition "), F.nullif(oxides, F.lit(""))), description, F.concat(F.lit("properties: "), F.nullif(wanted, F.lit(""))))
    return F.nullif(full, F.lit(""))
