"""Stored partial aggregates that merge: an hour or a day is summed up once, and every wider report comes from these rows and not from the events.

Percentiles are KLL sketches of ``K``: exact up to ``K`` values, else the rank is off by about 0.07 % of the rows at most in 99 of 100 cases. Distinct counts
are HyperLogLog sketches of 2 ** ``LG_K`` registers: off by about 0.4 % (one standard error). An event is in one row before the merge.
Sums are kept in decimals of eight places, so they do not depend on the order of merging.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, LG_K = 4096, 16
_PARTS = ("n", "total", "failures", "sketch")


def latency_parts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, n, total, failures, sketch) of each stretch of time; a stream gives a stretch once the watermark has passed its end."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    value = F.col("value").cast("double")
    parts = rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.sum(value.cast("decimal(28,8)")).alias("total"), F.count_if(F.col("event_type") == "error").alias("failures"), F.kll_sketch_agg_double(value, F.lit(K)).alias("sketch"))
    return parts.select(F.col("window.start").alias("start"), *_PARTS)


def merged(parts: DataFrame, *by: str | Column) -> DataFrame:
    """``parts`` put together by group, still mergeable."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("failures").alias("failures"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"))


def report(parts: DataFrame, *keep: str, digits: int = 3, at: Sequence[tuple[str, float]] = (("p50", 0.5), ("p95", 0.95))) -> DataFrame:
    """Requests, mean, percentiles and failures of merged parts."""
    ranks = [F.round(F.kll_sketch_get_quantile_double("sketch", F.lit(q)), digits).alias(name) for name, q in at]
    return parts.select(*keep, "n", F.round(F.col("total") / F.col("n").cast("decimal(20,0)"), digits).cast("double").alias("mean"), *ranks, "failures")


def sliding(parts: DataFrame, until: Column, hours: int = 24) -> DataFrame:
    """Hourly ``parts`` as windows of ``hours`` sliding by one, those that end by ``until``; an hour goes into ``hours`` windows, its events do not."""
    starts = F.sequence(F.col("start") - F.expr(f"INTERVAL {hours - 1} HOURS"), F.col("start"), F.expr("INTERVAL 1 HOUR"))
    rows = parts.withColumn("window_start", F.explode(starts)).where(F.col("window_start") + F.expr(f"INTERVAL {hours} HOURS") <= until)
    return merged(rows, "window_start")


def last_hours(parts: DataFrame, events: DataFrame, hours: int = 24) -> DataFrame:
    """One merged row of the ``hours`` before the latest event: whole hours from ``parts``, the first one's remainder from the events of that hour alone."""
    ts = F.col("ts").cast("timestamp")
    last = parts.agg(F.max("start")).head()[0]
    if last is None:
        return merged(parts)
    newest = events.where(ts >= F.lit(last)).agg(F.max(ts).alias("m")).head()["m"]
    cut = F.lit(newest) - F.expr(f"INTERVAL {hours} HOURS")
    edge = F.date_trunc("hour", cut)
    first = events.where((ts > cut) & (ts < edge + F.expr("INTERVAL 1 HOUR")))
    return merged(parts.where(F.col("start") > edge).select(*_PARTS).unionByName(latency_parts(first).select(*_PARTS)))


def user_parts(events: DataFrame, user: str = "user_id") -> DataFrame:
    """(day, events, users) of each day; ``users`` merges into any longer time."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.hll_sketch_agg(user, F.lit(LG_K)).alias("users"))


def active_users(parts: DataFrame, days: Sequence[int] = (7, 30)) -> DataFrame:
    """(days, users, events) of the last ``days`` days, the latest day's included."""
    last = parts.agg(F.max("day").alias("last"))  # one row
    spans = parts.join(F.broadcast(last)).withColumn("days", F.explode(F.array(*map(F.lit, days)))).where("datediff(last, day) < days")
    return spans.groupBy("days").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.sum("events").alias("events"))


def user_days(events: DataFrame, user: str = "user_id") -> DataFrame:
    """(day, user, events): the exact form of ``user_parts``, a row for each user of a day."""
    return events.groupBy(F.to_date("ts").alias("day"), F.col(user).alias("user")).agg(F.count("*").alias("events"))


def active_users_exact(rows: DataFrame, days: Sequence[int] = (7, 30)) -> DataFrame:
    """As ``active_users`` from ``user_days``: a user's days are put together first, so no task holds the users. Always a row for each of ``days``; a null user's events count, not the user."""
    last = rows.agg(F.max("day").alias("last"))  # one row
    aged = rows.join(F.broadcast(last)).withColumn("age", F.datediff("last", "day"))
    one = aged.groupBy("user").agg(*[F.sum(F.when(F.col("age") < d, F.col("events"))).alias(f"_{d}") for d in days])
    all_ = one.agg(*[c for d in days for c in (F.count_if(F.col("user").isNotNull() & F.col(f"_{d}").isNotNull()).alias(f"_users_{d}"), F.coalesce(F.sum(f"_{d}"), F.lit(0)).alias(f"_events_{d}"))])
    return all_.select(F.inline(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"_users_{d}").alias("users"), F.col(f"_events_{d}").alias("events")) for d in days])))
