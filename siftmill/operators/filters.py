"""Row filters, quality gates and constraint reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def by_metadata(df: DataFrame, equals: dict[str, str] | None = None, among: dict[str, Sequence] | None = None) -> DataFrame:
    """Optional equality and membership predicates; they reach the scan, and partitions where the columns partition it."""
    for name, value in (equals or {}).items():
        df = df.where(F.col(name) == value)
    for name, values in (among or {}).items():
        df = df.where(F.col(name).isin(*values))
    return df


def any_keyword(df: DataFrame, words: Sequence[str], columns: Sequence[str], most: int = 8) -> DataFrame:
    hit = F.lit(False)
    for word in list(words)[:most]:
        for c in columns:
            hit = hit | F.col(c).ilike(f"%{word}%")
    return df.where(hit)


def word_band(df: DataFrame, column: str, least: int = 20, most: int = 2000) -> DataFrame:
    return df.where(X.word_count(F.col(column)).between(least, most))


def relevant(df: DataFrame, column: str, vocabulary: Sequence[str], least: int = 2) -> DataFrame:
    return df.where(F.size(X.terms_in(F.col(column), vocabulary)) >= least)


def qa_reject_reason(question: Column, answer: Column) -> Column:
    """The first failing rule, or null."""
    q, a = F.trim(question), F.trim(answer)
    bad = F.lit(False)
    for p in X.BAD_ANSWERS:
        bad = bad | F.lower(a).rlike(p)
    return (
        F.when(F.length(q) < 15, "question too short").when(F.length(a) < 30, "answer too short").when(F.length(a) > 4000, "answer too long")
        .when(X.word_count(a) < 5, "too few words").when(bad, "bad pattern")
    )


def long_enough(column: str, least: int = 20) -> Column:
    return X.word_count(F.col(column)) >= least


def drop_short(df: DataFrame, column: str, exempt: Column, least: int = 20) -> DataFrame:
    return df.where(long_enough(column, least) | exempt)


def enough_letters(column: str, share: float = 0.5, longer_than: int = 50, letters: str | None = None) -> Column:
    n = F.length(column)
    return ~(((F.col(letters) if letters else X.n_letters(F.col(column))) < n * share) & (n > longer_than))


def drop_low_letters(df: DataFrame, column: str, exempt: Column, share: float = 0.5, longer_than: int = 50, letters: str | None = None) -> DataFrame:
    """``letters`` names a column that has a text's number of letters already."""
    return df.where(enough_letters(column, share, longer_than, letters) | exempt)


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.trim(column) != ""))


def text_quality(text: Column, terms: Sequence[str]) -> Column:
    """0 to 1 from length, word length, number of sentences and a domain term."""
    words, n = X.tokens(text), F.length(text)
    mean = F.try_divide(F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)), F.size(words))  # a blank text has no words
    n_sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != ""))
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.round(one((n > 100) & (n < 100_000), 0.3) + one((mean > 3) & (mean < 10), 0.2) + one(n_sentences > 5, 0.2) + one(X.contains_any(text, terms), 0.3), 1)


#: Marks of echoed context and openings of answers that only describe the text; fixed values.
ECHOES, COMMENTS = ("[source n]", "source_type"), ("the text is written", "the text is a reference", "this text describes", "this response is referenced")


def degenerate(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Adds ``degenerate``: under 5 words or null; over 20 words with a 3-gram five times; an echo mark twice; under 30 words that comment on the text;
    or under 50 characters without . : or ،"""
    text, words, low = F.col(column), X.tokens(F.col(column)), F.lower(F.col(column))
    grams = df.select(*keys, words.alias("w")).where(F.size("w") > 20)
    grams = grams.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(" ", F.slice("w", i, 3)))).alias("gram"))
    looping = grams.groupBy(*keys, "gram").count().where("count >= 5").select(*keys).distinct().withColumn("looping", F.lit(True))
    short = text.isNull() | (F.size(words) < 5) | ((F.length(text) < 50) & ~text.rlike("[.:،]"))
    echo = reduce(or_, [F.size(F.split(low, f"\\Q{m}\\E")) > 2 for m in ECHOES])
    comment = (F.size(words) < 30) & reduce(or_, [low.contains(c) for c in COMMENTS])
    return df.join(looping, list(keys), "left").withColumn("degenerate", short | F.coalesce("looping", F.lit(False)) | echo | comment).drop("looping")


def mostly_ascii(text: Column, share: float = 0.6, least: int = 5) -> Column:
    """Whether ASCII words outweigh ``share`` of the words longer than two characters that are no numbers or formulas."""
    words = F.filter(X.tokens(text), lambda w: (F.length(w) > 2) & ~w.rlike(r"^[0-9.,%-]+$") & ~w.rlike(r"^[A-Z][a-z]?[0-9]"))
    return (F.size(words) >= least) & (F.size(F.filter(words, lambda w: w.rlike(r"^[\x00-\x7F]+$"))) > F.size(words) * share)


def length_gates(text: Column, chars: Sequence[int], words: Sequence[int]) -> list[Column]:
    n = X.word_count(text)
    return [(F.length(text) >= c).alias(f"chars_{c}") for c in chars] + [(n >= w).alias(f"words_{w}") for w in words]


def violations(df: DataFrame, rules: dict[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """(rule, violations): rows that break each rule, and surplus rows of keys that should be unique; one pass each."""
    one = df.agg(*[F.coalesce(F.sum(F.when(~c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n) for n, c in rules.items()])
    out = one.unpivot([], list(rules), "rule", "violations")
    if unique:
        surplus = df.groupBy(*unique).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations"))
        out = out.unionByName(surplus.withColumn("rule", F.lit("unique_" + "_".join(unique))))
    return out
