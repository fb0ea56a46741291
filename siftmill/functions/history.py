"""Conversation history as it goes into a prompt: earlier context blocks stripped, old turns shortened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of earlier context blocks and of the question after them; fixed values.
CONTEXT, QUESTION, REFERENCE, ASKED = "KNOWLEDGE BASE CONTEXT:", "QUESTION:", "Reference information:", "Based on the reference information above, answer this question:"
#: Characters that stay of a context without a question, of an old answer and of an old question; fixed values.
LEFT, ANSWER, OLD_QUESTION = 500, 400, 250
_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _after(text: Column, mark: str) -> Column:
    """What stands after the last ``mark``, without white space at its ends; null without a mark."""
    parts = F.split(text, mark)
    return F.when(F.size(parts) > 1, F.regexp_replace(F.element_at(parts, -1), _ENDS, ""))


def clean_history(text: Column) -> Column:
    """The question behind an earlier context block; a block without one keeps its lines that are no rule, source mark or heading, as one line."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~(x.startswith("=") | x.startswith("-" * 10) | x.startswith("[Source") | x.contains("KNOWLEDGE BASE")))
    block = F.coalesce(_after(text, QUESTION), F.substring(F.array_join(kept, " "), 1, LEFT))
    return F.when(text.contains(CONTEXT), block).when(text.contains(REFERENCE), F.coalesce(_after(text, ASKED), text)).otherwise(text)


def shortened(text: Column, most: int = ANSWER) -> Column:
    """A long text up to the last full stop before a space within ``most`` characters, all of these if there is none, and a mark for the cut."""
    first = F.substring(text, 1, most)
    kept = F.when(first.contains(". "), F.regexp_extract(first, r"(?s)^(.*)\. ", 1)).otherwise(first)
    return F.when(F.length(text) > most, F.concat(kept, F.lit(". [...]"))).otherwise(text)


def compressed(turns: DataFrame, session: str, order: str, full: int = 8, middle: int = 12) -> DataFrame:
    """``turns`` (role, text) with ``content``: the last ``full`` of a session whole, of the ``middle`` before them answers shortened, of older ones the questions' beginnings only.

    Everything is cleaned first. Null texts stay null; turns with equal ``order`` stand in any order.
    """
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    rows = turns.withColumn("_back", back).where((F.col("_back") <= full + middle) | (F.col("role") == "user")).withColumn("content", clean_history(F.col("text")))
    old = F.when(F.col("_back") <= full + middle, F.when(F.col("role") == "assistant", shortened(F.col("content"))).otherwise(F.col("content"))).otherwise(F.substring("content", 1, OLD_QUESTION))
    return rows.withColumn("content", F.when(F.col("_back") <= full, F.col("content")).otherwise(old)).drop("_back")
