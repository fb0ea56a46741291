"""Training-set construction: unions, splits, caps, mixes, chat records and examples from answers, chunks and rows.

Random choices are md5 buckets of an id and a seed: the same under any partitioning, and in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def seeded(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_distinct(parts: Sequence[DataFrame], text: str, key: str) -> DataFrame:
    """The first row of each normalised text over the parts in order."""
    ranked = union_all([p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)])
    rank = F.row_number().over(Window.partitionBy(F.md5(X.norm_question(F.col(text)))).orderBy("source_rank", key))
    return ranked.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def ratio_split(df: DataFrame, key: str, seed: str, percent: int) -> DataFrame:
    """Adds ``split``: about ``percent`` of the rows are train."""
    return df.withColumn("split", F.when(X.hash_bucket(F.col(key).cast("string"), seed) < percent, "train").otherwise("val"))


def numbered(df: DataFrame, bucket: Column, order: Sequence[str]) -> DataFrame:
    """Adds ``line_no`` from 0 in a global order of which ``bucket`` is the coarse part.

    Rows are ranked in their bucket and shifted by the rows of the buckets before; only the table of bucket
    sizes is ordered as a whole, so no task holds more than a bucket.
    """
    d = df.withColumn("_bucket", bucket)
    sizes = d.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    d = d.withColumn("_place", place).join(sizes.select("_bucket", before.alias("_before")), "_bucket")
    return d.withColumn("line_no", F.col("_place") + F.col("_before")).drop("_bucket", "_place", "_before")


def exact_holdout(df: DataFrame, key: str, seed: str, share: float, least: int) -> DataFrame:
    """Adds ``split``: exactly ``max(share, least)`` rows are val (the share rounded half up), those first in the seeded order."""
    n = df.count()
    size = min(n, max(int((n * Decimal(str(share))).quantize(Decimal(1), ROUND_HALF_UP)), least))
    d = df.withColumn("_h", seeded(F.col(key), seed))
    digits = min(5, max(3, len(f"{n // 4000:x}")))  # even buckets, of about 4,000 rows up to a million buckets
    d = numbered(d, F.substring("_h", 1, digits), ["_h", key])
    return d.withColumn("split", F.when(F.col("line_no") < size, "val").otherwise("train")).drop("_h", "line_no")


def cap_groups(df: DataFrame, by: str, key: str, seed: str, caps: dict[str, int], default: int) -> DataFrame:
    """At most the capped number of rows of each group, chosen in seeded order.

    A group is counted by the first four digits of its rows' hashes. Rows of digits that fit whole are kept as they are, those beyond are dropped, and only where
    the cap falls within one of the 65,536 is a sort needed: no task sorts a group. A null group is one too.
    """
    cap = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col(by)), F.lit(default))
    d = df.withColumn("_h", seeded(F.col(key), seed)).withColumn("_digits", F.substring("_h", 1, 4))
    sizes = d.groupBy(F.col(by).alias("_by"), F.col("_digits").alias("_own")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sizes.withColumn("_before", before), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_digits") == F.col("_own"))).where(F.col("_before") < cap)
    rank = F.row_number().over(Window.partitionBy(by, "_digits").orderBy("_h", key))
    return d.withColumn("_rank", rank + F.col("_before")).where(F.col("_rank") <= cap).select(df.columns)


def distractors(df: DataFrame, key: str, text: str, seed: str, bucket: int = 4000, piece: int = 800, most: int = 6000) -> DataFrame:
    """Adds ``context``: the row's own text among those of its next three neighbours in its seeded bucket, shuffled.

    There are as many buckets as make about ``bucket`` rows each, so a task's window does not grow with the table.
    """
    buckets = max(1, -(-df.count() // bucket))
    h = seeded(F.col(key), seed)
    w = Window.partitionBy(X.hash_bucket(F.col(key).cast("string"), seed, buckets)).orderBy(h, key)
    own = F.struct(h.alias("h"), F.substring(text, 1, piece).alias("t"))
    d = df.withColumn("_own", own)
    parts = F.filter(F.array(F.col("_own"), *[F.lead("_own", i).over(w) for i in (1, 2, 3)]), lambda s: s.isNotNull())
    return d.withColumn("_all", parts).withColumn("context", F.substring(F.array_join(F.transform(F.array_sort("_all"), lambda s: s["t"]), "\n---\n"), 1, most)).drop("_own", "_all")


def chat_record(language: Column, question: Column, answer: Column, systems: dict[str, str], default: str) -> Column:
    """An array of system, user and assistant messages."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    system = F.lit(default)
    for name, text in systems.items():
        system = F.when(language == name, text).otherwise(system)
    return F.array(said("system", system), said("user", question), said("assistant", answer))


def topic_phrase(text: Column) -> Column:
    """The first sentence of 20 to 200 characters in the first 500, cut to 150; else the first 100 characters."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found = F.filter(F.transform(F.split(F.substring(text, 1, 500), r"[.!?\n]+"), strip), lambda s: F.length(s).between(20, 200))
    return F.coalesce(F.substring(F.try_element_at(found, F.lit(1)), 1, 150), strip(F.substring(text, 1, 100)))


def wide_to_text(columns: Sequence[str], most: int) -> Column:
    """``name=value`` of the first positive values in column order."""
    cells = F.filter(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]), lambda x: x.isNotNull())
    return F.array_join(F.slice(cells, 1, most), ", ")


def system_label(columns: dict[str, str], over: float, most: int) -> Column:
    """Names of the first components over a share, sorted and joined."""
    names = F.filter(F.array(*[F.when(F.col(c) > over, F.lit(n)) for n, c in columns.items()]), lambda x: x.isNotNull())
    return F.array_join(F.array_sort(F.slice(names, 1, most)), "-")
