"""Activity, trends, popular searches and demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hours_before(ts: str, as_of: str, first: int, last: int = 0):
    """Whether ts lies more than `last` and up to `first` hours before as_of (at least `last`, less than `first`)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return (F.col(ts) >= end - F.expr(f"INTERVAL {first} HOURS")) & (F.col(ts) < end - F.expr(f"INTERVAL {last} HOURS"))


def hourly(activity: DataFrame) -> DataFrame:
    """Events of each product, type and hour; a client counts once an hour, events without a client always."""
    rows = activity.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    by = rows.groupBy("product_id", "event_type", "hour")
    return by.agg((F.count_distinct("client_id") + F.count_if(F.col("client_id").isNull())).alias("n"))


def trending(hours: DataFrame, as_of: str, recent: int = 48, baseline: int = 48, least: int = 3, limit: int | None = None) -> DataFrame:
    """Products with more events in the recent hours than in as many before; momentum is their ratio."""
    by = hours.groupBy("product_id").agg(
        F.coalesce(F.sum(F.when(hours_before("hour", as_of, recent), F.col("n"))), F.lit(0)).alias("recent"),
        F.coalesce(F.sum(F.when(hours_before("hour", as_of, recent + baseline, recent), F.col("n"))), F.lit(0)).alias("baseline"),
    )
    rows = by.where((F.col("recent") >= least) & ((F.col("baseline") == 0) | (F.col("recent") > F.col("baseline"))))
    rows = rows.withColumn("momentum", F.round(F.col("recent") / F.greatest("baseline", F.lit(1)), 4))
    return rows.orderBy(F.desc("momentum"), F.desc("recent"), "product_id").limit(limit) if limit else rows


def popular(hours: DataFrame, as_of: str, window: int = 168, least: int = 5) -> DataFrame:
    """Products with at least so many events in the window."""
    return hours.where(hours_before("hour", as_of, window)).groupBy("product_id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def popular_queries(searches: DataFrame, as_of: str, days: int = 14, least_hits: int = 5, least_actors: int = 3) -> DataFrame:
    """Searches with results, asked often enough by enough different sessions; sensitive ones are left out."""
    rows = searches.where(hours_before("ts", as_of, 24 * days) & (F.col("results") > 0) & F.length(F.trim(F.coalesce("query", F.lit("")))).between(2, 80))
    rows = rows.where(~F.col("query").rlike("(?i)(password|otp|token|ssn|aadhaar)"))
    by = rows.groupBy("query").agg(F.count("*").alias("hits"), F.count_distinct("session").alias("actors"))
    return by.where((F.col("hits") >= least_hits) & (F.col("actors") >= least_actors))


def demand(searches: DataFrame, as_of: str, promote: float = 70.0) -> DataFrame:
    """Demand of each query: counts of a day and a week, sessions of a day, coverage, score and whether to promote it."""
    day, week = hours_before("ts", as_of, 24), hours_before("ts", as_of, 168)
    by = searches.groupBy("query").agg(
        F.count_if(day).alias("n_24h"), F.count_if(week).alias("n_7d"), F.count_distinct(F.when(day, F.col("session"))).alias("users_24h"),
        F.max_by("results", F.struct("ts", "search_id")).alias("last_results"), F.max("ts").alias("last_seen"),
    )
    missing = F.col("last_results") == 0
    score = F.least(F.lit(100), 40 + F.when(missing, 20).otherwise(0) + F.least(F.lit(30), F.col("n_24h")) + F.least(F.lit(20), F.col("users_24h")))
    out = by.withColumn("coverage", F.when(missing, "missing").otherwise("covered")).withColumn("score", score.cast("double"))
    return out.withColumn("promotable", missing & (F.col("score") >= promote))
