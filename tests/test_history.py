import re

from pyspark.sql import functions as F

from siftmill.functions import history
from siftmill.operators import filters

TEXTS = [
    None, "", "plain", "a. b " * 200, "x" * 900, "KNOWLEDGE BASE CONTEXT:\nabc\nQUESTION: one QUESTION:  two \n", "KNOWLEDGE BASE CONTEXT:\n=====\nkept\n----------\n-----\n[Source 1] t\n  [Source kept",
    "KNOWLEDGE BASE CONTEXT:\n" + "long line\n" * 100, "Reference information:\nz\nBased on the reference information above, answer this question: why?\n", "Reference information: only", "QUESTION: no block", "s. " * 133 + "t" * 300, "word. " + "y" * 394 + ". z",
]


def clean(t):
    if not t:
        return t
    if "KNOWLEDGE BASE CONTEXT:" in t:
        if "QUESTION:" in t:
            return t.rsplit("QUESTION:", 1)[1].strip()
        return " ".join(x for x in t.split("\n") if not re.match(r"=|-{10}|\[Source", x) and "KNOWLEDGE BASE" not in x)[:500]
    mark = "Based on the reference information above, answer this question:"
    return t.rsplit(mark, 1)[1].strip() if "Reference information:" in t and mark in t else t


def test_cleaning_and_shortening(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").select("text", history.clean_history(F.col("text")).alias("c"), history.shortened(F.col("text")).alias("s")).collect()
    for r in rows:
        t = r["text"]
        assert r["c"] == clean(t)
        assert r["s"] == (t[:400].rsplit(". ", 1)[0] + ". [...]" if t and len(t) > 400 else t)


def test_tiers_of_a_long_session(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", TEXTS[i % len(TEXTS)]) for i in range(50)] + [(2, 0, "assistant", "q" * 900)]
    got = {(r["s"], r["i"]): r["content"] for r in history.compressed(spark.createDataFrame(turns, "s long, i long, role string, text string"), "s", "i").collect()}
    want = {}
    for s, i, role, text in turns:
        back, c = (49 if s == 1 else 0) - i + 1, clean(text)
        if back <= 8:
            want[s, i] = c
        elif back <= 20:
            want[s, i] = c[:400].rsplit(". ", 1)[0] + ". [...]" if role == "assistant" and c and len(c) > 400 else c
        elif role == "user":
            want[s, i] = c and c[:250]
    assert got == want


def test_answers_that_echo_or_comment(spark):
    texts = ["[source n] and [SOURCE N] in a row of words.", "one [source n] only in a row of words.", "source_type: a source_type: b and more words", "The text is written in a plain way.", "word " * 30 + "this text describes it.", None, "A b c a b c a b c a b c a b C " + "x y z w v u t s r q.", "same few words " * 8 + "."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r["degenerate"] for r in filters.degenerate(df, ["id"], "text").orderBy("id").collect()]
    assert got == [True, False, True, True, True, True, False, True]
