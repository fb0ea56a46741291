"""Words and their spelling variants: words one edit apart, met by pivotal bigrams, and the frequent form of each.

Bigrams are ordered by how many words have them, rarest first. A word's prefix is its three first bigrams (and every other place of the third), its
pivots are two of the three that do not overlap and are rarest together. One edit touches at most one of two disjoint bigrams, so of two words that are
near, the one whose prefix ends earlier has a pivot in the other's prefix, its place moved by one at most. A pair therefore meets where a
pivot of one is a bigram of the other's prefix.

There are only some thousand bigrams, so a bigram alone would bring a share of all words together. The key of the meeting also holds half of the
word: an edit falls into one half of the longer word, and the other half is equal. With ``m`` the longer word's length, that is the first
``m // 2`` or the last ``m - m // 2`` code points. A word is entered for the words of its length, for those one longer and one shorter. A pivot that
lies in the equal half is whole, so it alone is entered there. The half that has the edit is halved again, and one of these quarters must be equal too: their
hashes are compared where a pair is met. No pair is lost by any of this, and what is met is verified by edit distance.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, lean
from .common import crc32_sql, small_batches, written

LEAST, TIMES = 7, 10
#: Of Latin-1 bytes: A-Z to a-z, letters from U+00C0 on stay, everything else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: So many different words a task holds before it passes their counts on.
_HELD = 200_000


def varied(doc_id: int | None, run: bytes) -> bytes:
    """The run as the corpus holds it: where 31 divides h, its code point h % length is deleted; h is the crc32 of ``<doc_id>:<run>`` in UTF-8. Without doc_id nothing is."""
    if doc_id is None:
        return run
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(b"%d:" % doc_id))
    at = h % len(run)
    return run if h % 31 else run[:at] + run[at + 1 :]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task and how often it met each; a word may come more than once."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    held: Counter[bytes] = Counter()
    for batch in batches:
        for block in blocks(batch, 1):
            for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                runs = Counter(w for w in (text or "").encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= LEAST)
                for run, n in runs.items():
                    word = varied(doc_id, run)
                    if len(word) >= LEAST:
                        held[word] += n
            if len(held) > _HELD:
                yield out()
                held.clear()
    yield out()


def word_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """(word, n) of every word of ``LEAST`` code points or more that occurs ``least`` times or more."""
    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_words), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _gram_codes(word: bytes) -> np.ndarray:
    codes = np.frombuffer(word, np.uint8).astype(np.int64)
    return codes[:-1] << 8 | codes[1:]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for word in batch.column(0).to_pylist():
            total[np.unique(_gram_codes(word.encode("latin-1")))] += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["gram", "words"])


def pivots(order: np.ndarray, prefix: np.ndarray, n: int = 2, width: int = 2) -> list[int]:
    """The ``n`` places of ``prefix`` (ascending) that lie at least ``width`` apart and whose orders have the smallest sum, by dynamic programming over places."""
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * n]
    for i, at in enumerate(prefix.tolist()):
        before = next((j + 1 for j in range(i - 1, -1, -1) if prefix[j] <= at - width), 0)
        row = list(best[-1])
        for k in range(1, n + 1):
            if (had := best[before][k - 1]) is not None and (row[k] is None or had[0] + order[at] < row[k][0]):
                row[k] = (had[0] + int(order[at]), (*had[1], at))
        best.append(row)
    return list(best[-1][n][1])


def _halves(word: bytes, m: int) -> Iterator[tuple[int, int, range]]:
    """For the first and for the last half that a word shares with one where the longer has ``m`` code points: a hash of it, the hashes of the quarters of the rest, and the places of bigrams within it."""
    n, head = len(word), m // 2
    tail = m - head
    for seed, half, rest, own, whole in ((m, word[:head], word[head:], tail, range(head - 1)), (-m, word[n - tail :], word[: n - tail], head, range(n - tail, n))):
        k = own // 2
        quarters = (xxhash.xxh3_64_intdigest(rest[:k]) & 0xFFFFF) << 20 | xxhash.xxh3_64_intdigest(rest[len(rest) - (own - k) :]) & 0xFFFFF
        yield xxhash.xxh3_64_intdigest(half, seed & _ALL), quarters, whole


_ALL, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15
#: To whom a row speaks: words of the same length, a longer word's pivots to shorter words, a shorter word's pivots to longer words.
_SAME, _LONGER, _SHORTER = range(3)


def signatures(word: bytes, rank: np.ndarray, pivot: bool) -> set[tuple[int, int]]:
    """(key, mark) of a word's pivots, or of its prefix; ``rank`` orders the bigrams, rarest first. A mark is, from the low end: place mod 256, rank of
    the prefix's last bigram (14 bits), hashes of the two quarters (20 bits each)."""
    grams = _gram_codes(word)
    order = rank[grams]
    first = np.argsort(order, kind="stable")[:3]
    last = int(order[first[-1]])
    places = pivots(order, np.sort(first)) if pivot else np.flatnonzero((order < last) | (grams == grams[first[-1]])).tolist()
    n, out = len(word), set()
    for m, tags in ((n, (_SAME, _LONGER if pivot else _SHORTER)), (n + 1, (_SHORTER if pivot else _LONGER,))):
        for base, quarters, whole in _halves(word, m):
            safe = [p for p in places if p in whole][:1] if pivot else []
            for at in safe or places:
                mark = quarters << 22 | last << 8 | at & 255
                for tag in tags:
                    out.add(((base ^ ((int(grams[at]) << 2 | tag) * _MIX & _ALL)) - (1 << 63), mark))
    return out


def _entered(batches: Iterator[pa.RecordBatch], rank: np.ndarray, pivot: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows = [(key, of, mark) for of, word in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for key, mark in signatures(word.encode("latin-1"), rank, pivot)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["key", "id", "mark"])


def gram_ranks(words: DataFrame) -> np.ndarray:
    """Place of each bigram in ascending order of the words that have it; there are at most 90 * 90 bigrams, so they are put together on the driver."""
    found = words.select("word").mapInArrow(lean(_gram_counts), "gram long, words long").groupBy("gram").agg(F.sum("words").alias("words")).collect()
    rank = np.zeros(1 << 16, np.int64)
    for i, row in enumerate(sorted(found, key=lambda r: (r["words"], r["gram"]))):
        rank[row["gram"]] = i
    return rank


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b, of the ids of all words that differ by exactly one inserted, deleted or replaced code point; ``words``: id, word, written."""
    rank = gram_ranks(words)
    entered = lambda pivot: words.select("id", "word").mapInArrow(lean(functools.partial(_entered, rank=rank, pivot=pivot)), "key long, id long, mark long")
    index = entered(True).select("key", F.col("id").alias("a"), F.col("mark").alias("x"))
    others = entered(False).select("key", F.col("id").alias("b"), F.col("mark").alias("y"))
    bits = lambda c, low, n: F.shiftright(c, low).bitwiseAND(F.lit((1 << n) - 1))
    x, y = F.col("x"), F.col("y")
    moved = F.pmod(bits(x, 0, 8) - bits(y, 0, 8) + 1, F.lit(256)) <= 2
    quarter = (bits(x, 22, 20) == bits(y, 22, 20)) | (bits(x, 42, 20) == bits(y, 42, 20))
    met = index.join(others, "key").where((F.col("a") != F.col("b")) & moved & (bits(x, 8, 14) <= bits(y, 8, 14)) & quarter)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = lambda side: words.select(F.col("id").alias(side), F.col("word").alias(f"word_{side}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms`` (id, form), where every form is far more frequent than the word, so ways end: they are followed in steps that double."""
    way = forms.select("id", F.col("form").alias("root"))
    while True:
        on = way.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        way = written(way.join(on, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "ways")
        moved, way = way.where("_moved").isEmpty(), way.drop("_moved")
        if moved:
            return way


def spelling_groups(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that occurs twice or more in ``docs`` (doc_id, text).

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z in lower case, as ``varied`` leaves them, of ``LEAST`` code points or more. A word's form is the most
    frequent of its near words (ties: the smallest in code-point order) if that occurs ``TIMES`` times as often. Null texts have no words; rows without doc_id are
    counted unchanged; repeated rows count again. Very long texts and runs are taken whole. An empty table has no rows.
    """
    with small_batches(docs.sparkSession):
        counted = written(word_counts(docs), "counts")
    words = written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = written(near_words(words), "near")
    both = pairs.union(pairs.select("b", "a"))
    of = words.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = both.join(of, "b").groupBy("a", "form_n").agg(F.count("*").alias("near"), F.min(F.struct("form", "b")).alias("first"))
    best = F.max(F.struct("form_n", "first")).alias("best")
    chosen = near.groupBy("a").agg(F.sum("near").alias("n_near"), best).select(F.col("a").alias("id"), "n_near", "best")
    rows = words.join(chosen, "id", "left")
    found = F.col("best.form_n") >= TIMES * F.col("n")
    rows = written(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(found, F.col(f"best.{c}")).alias(a) for c, a in (("first.form", "form"), ("first.b", "form_id"), ("form_n", "form_n"))]), "forms")
    ways = _roots(rows.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    last = ways.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return rows.join(last, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


#: Near words by what is left of them without one code point: equal to the other word, or equal for both at the same place.
SQL = f"""WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{{{{LEAST},}}}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT *, coalesce({crc32_sql("concat(doc_id, ':', run)")}, 1) AS h FROM runs),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN doc_id IS NOT NULL AND h % 31 = 0 THEN run[:(h % length(run))::BIGINT] || run[(h % length(run) + 2)::BIGINT:] ELSE run END AS word FROM hashed) WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, place, word[:place] || word[place + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS place FROM words)),
near AS (SELECT c.word AS a, w.word AS b FROM cut c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT c.word, d.word FROM cut c JOIN cut d ON c.rest = d.rest AND c.place = d.place AND c.word <> d.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS form, max(w.n) AS most FROM near JOIN words w ON w.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN form END AS form, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT w.word, w.next, f.form FROM ways w JOIN forms f ON f.word = w.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN ways r ON r.word = f.word AND r.next IS NULL""".replace("{{", "{").replace("}}", "}")
