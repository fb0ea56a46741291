"""Joins between queries, corpora, logs and their parents; near-duplicate and resume joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def near_duplicates(df: DataFrame, key: str, text: str, same: Sequence[str], prefix: int = 200, within: float = 0.05, longer_than: int = 50, length: Column | None = None) -> DataFrame:
    """Rows for which a row with a smaller key, equal ``same`` columns and prefix, and nearly equal length exists.

    ``length`` is the text's, where ``text`` holds only its beginning. Only the first such partner matters, so the texts stay out of the join: it runs on a prefix hash and lengths.
    Within a prefix group each distinct length meets those of its own and the neighbouring length bands (a band is
    as wide as the reach), so a hot prefix is compared neither row by row nor over all its lengths.
    """
    n = F.length(text) if length is None else length
    side = df.where(n > 0).select(F.col(key).alias("k"), *[F.col(c).alias(f"s_{c}") for c in same], F.xxhash64(F.substring(text, 1, prefix)).alias("p"), F.md5(F.substring(text, 1, prefix)).alias("q"), n.alias("n"))
    on = ["p", "q", *[f"s_{c}" for c in same]]
    # the earliest row of each length in a group stands for all of that length
    lengths = side.groupBy(*on, "n").agg(F.min("k").alias("first"))
    lengths = lengths.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1 / (1 - within)))))
    reach = lengths.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    near = reach.alias("a").join(lengths.alias("b"), [*on, "band"]).where(f"a.n > {longer_than} and abs(a.n - b.n) < a.n * {within}").groupBy(*on, F.col("a.n").alias("n")).agg(F.min("b.first").alias("least"))
    return side.join(near, [*on, "n"]).where("least < k").select(F.col("k").alias(key))


def keep_first(df: DataFrame, by: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row for each value of ``by``, the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def not_known(new: DataFrame, known: DataFrame, hash_of: Column, order: Sequence[Column]) -> DataFrame:
    """New rows whose content is not known yet, and of equal ones the first."""
    marked = new.withColumn("_hash", hash_of)
    seen = known.select(hash_of.alias("_hash")).distinct()
    return keep_first(marked.join(seen, "_hash", "left_anti"), [F.col("_hash")], order).drop("_hash")


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return todo.join(done.select(*keys), list(keys), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def merge_upgrades(original: DataFrame, upgrades: DataFrame, key: str, text: str) -> DataFrame:
    """The new text where it has more words than the old, else the old; with its source and word counts."""
    new = upgrades.select(key, F.col(text).alias("_new"))
    joined = original.join(new, key, "left")
    n_old, n_new = X.word_count(F.col(text)), X.word_count(F.col("_new"))
    better = F.col("_new").isNotNull() & (n_new > n_old)
    return joined.select(key, F.when(better, F.col("_new")).otherwise(F.col(text)).alias(text), F.when(better, "upgraded").otherwise("original").alias("origin"), n_old.alias("words_before"), F.when(better, n_new).otherwise(n_old).alias("words_after"))


def glossary_matches(queries: DataFrame, key: str, text: str, glossary: dict[str, str], most: int = 5) -> DataFrame:
    """Adds ``expanded``: the query with the first targets of glossary terms it contains, in glossary order."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in glossary.items()])
    hits = F.slice(F.filter(entries, lambda e: F.lower(F.col(text)).contains(F.lower(e["k"]))), 1, most)
    names = F.transform(hits, lambda e: e["v"])
    return queries.withColumn("expanded", F.when(F.size(names) > 0, F.concat(F.col(text), F.lit(" ("), F.array_join(names, ", "), F.lit(")"))).otherwise(F.col(text)))
