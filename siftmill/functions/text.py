"""Text expressions: each takes and returns columns and stays inside whole-stage code generation where it can."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Words that carry no search meaning; fixed values.
STOP_WORDS = [
    "what", "how", "why", "when", "where", "which", "who", "does", "do", "is", "are", "was", "were", "the", "a", "an", "of", "in", "for", "to", "and",
    "or", "with", "about", "from", "that", "this", "can", "tell", "me", "explain", "describe", "provide", "give", "its", "their", "they", "it", "be",
    "been", "being", "have", "has", "had",
]
#: Answers that say nothing, searched in lower case; fixed values.
BAD_ANSWERS = (r"i (don't|do not|cannot|can't) know", r"i'm not sure", r"no (answer|information|data) (available|found|provided)", r"^n/?a$", r"\berror\b", r"\bexception\b")
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"


def tokens(text: Column | str) -> Column:
    """Words between white space, none of them empty."""
    return F.array_remove(F.split(text, r"\s+"), "")  # a filter by a lambda takes four times as long


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of ``words`` occurs, in any case."""
    low = F.lower(text)
    return F.coalesce(F.greatest(*[low.contains(w.lower()) for w in words], F.lit(False)), F.lit(False))


def terms_in(text: Column, words: Sequence[str]) -> Column:
    """The array of those ``words`` that occur, in their order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(F.lower(w)))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z؀-ۿ ]", "")


_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), ord(" "), *range(0xD8, 0xDC)]] = 1


def n_letters(text: Column) -> Column:
    """``length(letters_only(text))``, counted over the bytes: in UTF-8 the characters from U+0600 to U+06FF are those that begin with D8 to DB."""

    def count(texts: pa.Array) -> pa.Array:
        data = texts.cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        out = np.zeros(len(data), np.int64)
        held = np.frombuffer(data.buffers()[2] or b"", np.uint8)
        for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):  # one text at a time, so that memory does not grow with the batch
            out[i] = _LETTER[held[lo:hi]].sum()
        return pa.array(out, mask=data.is_null().to_numpy(zero_copy_only=False))

    return arrow_udf(count, "long")(text)


def norm_question(text: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.md5(F.lower(F.trim(text)))


def script_language(text: Column, first: int = 50) -> Column:
    return F.when(F.substring(text, 1, first).rlike("[؀-ۿ]"), "fa").otherwise("en")


#: Fixed values, pattern and replacement in order; the third is what a text needs to hold for a match, looked for first; the classes for URLs and symbols are written out, as neither Java nor DuckDB has a Unicode ``\w``. Page numbers, upper-case header lines, URLs, e-mail addresses, symbols, space before punctuation.
CLEANING = (
    (r" {2,}", " ", "  "), (r"\n{3,}", "\n\n", "\n\n\n"), (r"\n\d+\n", "\n", "\n"), (r"\n- \d+ -\n", "\n", "\n- "), (r"\n[A-Z\s]{10,}\n", "\n", "\n"), (r"https?://[!$-_a-z]+", "", "http"), (r"(?<!\S)\S+@\S+", "", "@"),
    (r"[^\p{L}\p{N}_\s\p{Z}.,;:!?()\[\]{}'\"°%$€£¥/\\-]", " ", ""), (r"[\s\p{Z}]+([.,;:!?])", "$1", ""), (r"^[\s\p{Z}]+|[\s\p{Z}]+$", "", ""),
)


def clean_text(text: Column) -> Column:
    """Drops page numbers between lines, upper-case header lines, URLs and e-mail addresses; stray symbols become spaces."""
    for pattern, to, needs in CLEANING:
        replaced = lambda a: F.when(a.contains(needs), F.regexp_replace(a, pattern, to)).otherwise(a)  # noqa: B023, E731
        text = F.transform(F.array(text), replaced)[0] if needs else F.regexp_replace(text, pattern, to)  # a lambda's argument is computed once
    return text


def clean_page_lines(text: Column) -> Column:
    """Trimmed lines without blank, all-digit, page-marker and very short ones."""
    lines = F.transform(F.split(F.translate(text, "\0", ""), "\n"), lambda x: F.trim(x))  # F.trim itself would take the place of a line as characters to cut
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 4) & ~x.rlike(r"^\d+$") & ~F.lower(x).rlike(r"^(page|p\.)\s*\d+")), "\n")


def sentences(text: Column) -> Column:
    """Split after . ! ? where a capital follows; white space collapsed."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(F.regexp_replace(flat, r"([.!?]) ([A-Z])", "$1\u0001$2"), "\u0001"), lambda s: s != "")


def query_keywords(query: Column) -> Column:
    """Search words in lower case; formulas keep their case; stop words and words of two letters go."""
    found = F.regexp_extract_all(query, F.lit(r"([A-Za-z][A-Za-z0-9]*(?:[.-][A-Za-z0-9]+)*)"), 1)
    formula = lambda w: w.rlike(r"^[A-Z][a-z]?\d")
    kept = F.filter(found, lambda w: formula(w) | (~F.lower(w).isin(STOP_WORDS) & (F.length(w) > 2)))
    return F.transform(kept, lambda w: F.when(formula(w), w).otherwise(F.lower(w)))


def reference_words(text: Column) -> Column:
    """Distinct lower-case words of more than three characters."""
    return F.array_distinct(F.filter(tokens(F.lower(text)), lambda w: F.length(w) > 3))


def keyword_coverage(answer: Column, reference: Column) -> Column:
    """Share of the reference's words among the answer's words; 1 if the reference has none."""
    want = reference_words(reference)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, tokens(F.lower(answer)))) / F.size(want))


def keyword_overlap(retrieved: Column, reference: Column) -> Column:
    """Share of the reference's words that occur anywhere in the retrieved text; 1 if the reference has none."""
    want, low = reference_words(reference), F.lower(retrieved)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.filter(want, lambda w: low.contains(w))) / F.size(want))


def first_match(text: Column, classes: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first class one of whose words occurs."""
    out = None
    for name, words in classes:
        hit = contains_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def snippet(text: Column, word: str, around: int = 60) -> Column:
    """The surroundings of the first hit, with ellipses where text is left out."""
    at = F.locate(word.lower(), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    length = at - start + len(word) + around
    return F.concat(F.when(start > 1, "...").otherwise(""), text.substr(start, length), F.when(start + length - 1 < F.length(text), "...").otherwise(""))


def validate_citations(text: Column, n_sources: int) -> Column:
    """Removes ``[Source n]`` marks, in either script, whose number is not 1..n_sources."""
    marks = F.regexp_extract_all(text, F.lit("(\\[(?:Source|منبع) [0-9" + PERSIAN_DIGITS + "]+\\])"), 1)
    number = lambda m: F.regexp_replace(F.translate(m, PERSIAN_DIGITS, "0123456789"), r"[^0-9]", "").cast("long")
    bad = F.filter(marks, lambda m: ~number(m).between(1, n_sources))
    return F.aggregate(bad, text, lambda t, m: F.replace(t, m, F.lit("")))


def section_items(text: Column, heading: str, least: int, most_items: int) -> Column:
    """Items under a heading up to the blank line, bullets stripped."""
    body = F.regexp_extract(text, rf"(?is){heading}[^\n]*\n(.*?)(?:\n\s*\n|\z)", 1)
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) >= least), 1, most_items)


def middle_out(text: Column, most: int, separator: str = "\n\n") -> Column:
    """Unchanged if short; with up to two paragraphs cut at a word; else the first, as many middle ones as fit, and the last."""
    parts = F.split(text, separator)
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*\z", "")
    ends = F.length(parts[0]) + F.length(F.element_at(parts, -1)) + 2 * len(separator)
    start = F.struct(F.array().cast("array<string>").alias("kept"), ends.cast("int").alias("used"), F.lit(False).alias("full"))

    def take(s, p):
        fits = ~s["full"] & (s["used"] + F.length(p) + len(separator) <= most)
        return F.struct(F.when(fits, F.concat(s["kept"], F.array(p))).otherwise(s["kept"]).alias("kept"), F.when(fits, s["used"] + F.length(p) + len(separator)).otherwise(s["used"]).cast("int").alias("used"), (~fits).alias("full"))

    middle = F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 2), start, take)["kept"]
    packed = F.array_join(F.concat(F.array(parts[0]), middle, F.array(F.element_at(parts, -1))), separator)
    return F.when(F.length(text) <= most, text).when((F.size(parts) <= 2) | (ends > most), cut).otherwise(packed)


def hash_bucket(key: Column | str, seed: str, n: int = 100) -> Column:
    """A stable bucket of 0..n-1, the same under any partitioning."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(key) if isinstance(key, str) else key, F.lit(seed))), 1, 8), 16, 10).cast("long"), F.lit(n))
