"""Conversation turns with the context blocks that earlier requests left in them, and the DuckDB text of their cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

DRESSED = r"""SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN 'KNOWLEDGE BASE CONTEXT:' || chr(10) || '[Source 1] x' || chr(10) || text || chr(10) || 'QUESTION: ' || text || ' ' WHEN 1 THEN 'KNOWLEDGE BASE CONTEXT:' || chr(10) || '=====' || chr(10) || text || chr(10) || '----------' || chr(10) || '[Source 2] y' || chr(10) || 'end'
  WHEN 2 THEN 'Reference information:' || chr(10) || 'x' || chr(10) || 'Based on the reference information above, answer this question: ' || text ELSE text END AS text FROM conversations"""
CLEANED = r"""CASE WHEN contains(text, 'KNOWLEDGE BASE CONTEXT:') THEN CASE WHEN contains(text, 'QUESTION:') THEN regexp_replace(string_split(text, 'QUESTION:')[-1], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')
  ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (starts_with(x, '=') OR starts_with(x, '----------') OR starts_with(x, '[Source') OR contains(x, 'KNOWLEDGE BASE'))), ' ')[1:500] END
  WHEN contains(text, 'Reference information:') AND contains(text, 'Based on the reference information above, answer this question:') THEN regexp_replace(string_split(text, 'Based on the reference information above, answer this question:')[-1], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') ELSE text END"""


def dressed(t: Tables) -> DataFrame:
    """Three of four sessions carry a context block: with a question, without one, and in the other form."""
    text, kind = F.col("text"), F.col("conv_id") % 4
    said = (
        F.when(kind == 0, F.concat(F.lit("KNOWLEDGE BASE CONTEXT:\n[Source 1] x\n"), text, F.lit("\nQUESTION: "), text, F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("KNOWLEDGE BASE CONTEXT:\n=====\n"), text, F.lit("\n----------\n[Source 2] y\nend")))
        .when(kind == 2, F.concat(F.lit("Reference information:\nx\nBased on the reference information above, answer this question: "), text)).otherwise(text)
    )
    return t.conversations.select("conv_id", "turn", "role", said.alias("text"))
