"""Refresh scheduling, the work queue, platform health and freshness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_hours(ts: str, as_of: str) -> Column:
    return (F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz")) - F.unix_timestamp(ts)) / 3600


def refresh_due(listings: DataFrame, demand: DataFrame, open_tasks: DataFrame, as_of: str, hot: int = 6, normal: int = 24, cold: int = 72) -> DataFrame:
    """Listings due for a refresh by tier, in turns of the platforms: tier, due hours, rank in the platform.

    demand: product_id, n; open_tasks: platform, product_id of tasks that are pending or running.
    """
    rows = listings.join(demand, "product_id", "left").join(open_tasks, ["platform", "product_id"], "left_anti")
    tier = F.when(F.col("n") >= 100, "hot").when(F.col("n") >= 50, "normal").otherwise("cold")
    rows = rows.withColumn("tier", tier).withColumn("hours", F.when(F.col("tier") == "hot", hot).when(F.col("tier") == "normal", normal).otherwise(cold))
    due = rows.where(F.col("last_seen").isNull() | (age_hours("last_seen", as_of) >= F.col("hours")))
    order = [F.when(F.col("tier") == "hot", 0).when(F.col("tier") == "normal", 1).otherwise(2).asc(), F.col("last_seen").asc_nulls_first(), F.col("listing_id").asc()]
    return due.withColumn("platform_rank", F.row_number().over(Window.partitionBy("platform").orderBy(*order)).cast("long"))


def due_plans(plans: DataFrame, as_of: str) -> DataFrame:
    """Plans (plan_id, cadence_minutes, last_run, enabled) whose next run has come, with how late they are (minutes)."""
    late = (age_hours("last_run", as_of) * 60).cast("long") - F.col("cadence_minutes")
    return plans.where(F.col("enabled") & (F.col("last_run").isNull() | (late >= 0))).select("plan_id", F.coalesce(late, F.lit(0).cast("long")).alias("late_minutes"))


def requeue_stuck(tasks: DataFrame, as_of: str, minutes: int = 45, most: int = 3) -> DataFrame:
    """Running tasks whose lease is too old: pending again, or dead after `most` attempts."""
    stuck = (F.col("status") == "running") & (age_hours("leased_at", as_of) * 60 > minutes)
    state = F.when(stuck & (F.col("attempts") >= most), "dead").when(stuck, "pending").otherwise(F.col("status"))
    return tasks.withColumn("new_status", state).withColumn("delay_minutes", F.when(stuck, backoff(F.col("attempts"))))


def backoff(attempts: Column, base: int = 5, factor: int = 3, most: int = 360) -> Column:
    """base * factor ** (attempts - 1), at most `most`."""
    return F.least(F.lit(most), base * F.pow(F.lit(factor), F.greatest(attempts - 1, F.lit(0)))).cast("long")


def queue_state(tasks: DataFrame, as_of: str) -> DataFrame:
    """For each platform, tasks by status, the oldest pending one's age and those that died of late."""
    by = tasks.groupBy("platform")
    pending = F.col("status") == "pending"
    return by.agg(
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pending", "running", "completed", "dead")),
        F.max(F.when(pending, F.floor(age_hours("scheduled_at", as_of)))).alias("oldest_hours"),
        F.count_if((F.col("status") == "dead") & (age_hours("scheduled_at", as_of) <= 24 * 365)).alias("n_dead_recent"),
    )


def claim_order(tasks: DataFrame, as_of: str, most: int) -> DataFrame:
    """The pending tasks to take next: by priority, then due time, then age."""
    rows = tasks.where((F.col("status") == "pending") & (F.col("scheduled_at") <= F.lit(as_of).cast("timestamp_ntz")))
    return rows.orderBy("priority", "scheduled_at", "created_at", "task_id").limit(most)


def missing_platforms(listings: DataFrame, products: DataFrame, coverage: DataFrame) -> DataFrame:
    """Platforms that carry a product's category (coverage: category, platform) but don't list the product."""
    expected = products.where("status = 'active'").select("product_id", "category").join(F.broadcast(coverage), "category")  # coverage: platforms times categories
    return expected.join(listings.select("product_id", "platform").distinct(), ["product_id", "platform"], "left_anti")


def single_store(listings: DataFrame, as_of: str) -> DataFrame:
    """Products that one platform alone lists, with its last price and the hours since."""
    at = F.struct("last_seen", "listing_id")
    by = listings.groupBy("product_id").agg(F.count_distinct("platform").alias("n"), F.min("platform").alias("platform"), F.max_by("price", at).alias("price"), F.max("last_seen").alias("last_seen"))
    return by.where("n = 1").select("product_id", "platform", "price", F.floor(age_hours("last_seen", as_of)).alias("hours"))


def cooled_down(candidates: DataFrame, attempts: DataFrame, as_of: str, hours: int = 168) -> DataFrame:
    """Candidates (product_id, platform) without an attempt (product_id, platform, at) within the last hours."""
    recent = attempts.where(age_hours("at", as_of) < hours)
    return candidates.join(recent, ["product_id", "platform"], "left_anti")


def budget(tasks: DataFrame, limits: DataFrame) -> DataFrame:
    """Tasks used of each platform's daily limit (platform, daily_limit): used, left, available."""
    used = tasks.where("status <> 'dead'").groupBy("platform", F.to_date("scheduled_at").alias("day")).agg(F.count("*").alias("used"))
    rows = used.join(F.broadcast(limits), "platform")  # limits: one row a platform
    return rows.select("platform", "day", "used", F.greatest(F.col("daily_limit") - F.col("used"), F.lit(0)).alias("left"), (F.col("used") < F.col("daily_limit")).alias("available"))


def check_latency(checks: DataFrame, as_of: str, hours: int = 168) -> DataFrame:
    """Of each platform's recent checks: exact median and 95th percentile of latency, share of failures, hours since the last."""
    rows = checks.where(age_hours("ts", as_of) < hours)
    return rows.groupBy("platform").agg(
        F.count("*").alias("n"), F.expr("percentile(latency, 0.5) FILTER (WHERE ok)").alias("p50"), F.expr("percentile(latency, 0.95) FILTER (WHERE ok)").alias("p95"),
        F.round(100.0 * F.count_if(~F.col("ok")) / F.count("*"), 2).alias("fail_percent"), F.floor(F.min(age_hours("ts", as_of))).alias("hours_since"),
    )


def freshness(listings: DataFrame, as_of: str, bounds: tuple[int, ...] = (24, 720, 8760)) -> DataFrame:
    """Listings of each category by the hours since they were seen."""
    age = age_hours("last_seen", as_of)
    return listings.groupBy("category").agg(
        F.count("*").alias("n"), *(F.count_if(age <= b).alias(f"within_{b}h") for b in bounds), F.count_if(age > bounds[-1]).alias("stale"),
        F.count_if(F.col("match_status") == "needs_review").alias("needs_review"),
    )


def platform_pairs(listings: DataFrame) -> DataFrame:
    """How many products each set of platforms carries."""
    sets = listings.groupBy("product_id").agg(F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"))
    return sets.groupBy("platforms").agg(F.count("*").alias("n"))


def readiness(listings: DataFrame, coverage: DataFrame) -> DataFrame:
    """State of each covered platform and category: READY, LIMITED, THIN or EMPTY, by counts and priced share."""
    by = listings.groupBy("platform", "category").agg(F.count("*").alias("n"), F.count_if((F.col("price") > 0) & (F.col("stock") == "in_stock")).alias("n_buyable"), F.count_if(F.col("match_status") == "matched").alias("n_matched"))
    rows = coverage.join(by, ["platform", "category"], "left").na.fill(0, ["n", "n_buyable", "n_matched"])
    state = F.when(F.col("n") == 0, "EMPTY").when(F.col("n") < 20, "THIN").when((F.col("n_buyable") * 100 >= F.col("n") * 60) & (F.col("n_matched") * 100 >= F.col("n") * 85), "READY").otherwise("LIMITED")
    return rows.withColumn("state", state)


def stale_hot(listings: DataFrame, demand: DataFrame, known: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Listings of products in demand that weren't seen lately, but for those already known (listing_id)."""
    rows = listings.join(demand.where("n >= 50"), "product_id", "left_semi").where(age_hours("last_seen", as_of) > hours)
    return rows.join(known, "listing_id", "left_anti")


def admission(offers: DataFrame, as_of: str, fresh: int = 24, cooldown: int = 6) -> DataFrame:
    """Whether a live check of each product's best offer is due: busy, fresh, cooldown or due.

    offers: product_id, listing_id, price, in_stock, last_seen, failures, running.
    """
    order = Window.partitionBy("product_id").orderBy(F.desc("in_stock"), F.col("price").asc_nulls_last(), "listing_id")
    best = offers.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    wait = F.least(F.lit(64), F.pow(F.lit(2), F.least("failures", F.lit(8)))) * cooldown
    age = age_hours("last_seen", as_of)
    state = F.when(F.col("running"), "busy").when(age < fresh, "fresh").when((F.col("failures") > 0) & (age < wait), "cooldown").otherwise("due")
    return best.select("product_id", "listing_id", "price", state.alias("state"))


def circuit_breaker(checks: DataFrame, trip: int = 3, cooldown_hours: int = 6) -> DataFrame:
    """Each platform's health after all its checks in order: state, failures in a row, times it opened.

    A fold over time: `trip` failures in a row open the breaker; while it is open, checks before the cooldown are skipped;
    the first after it either closes or opens it anew. Runs by platform over batches that Spark has sorted, with a small
    state; nothing is gathered.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        platform, state = None, None
        out = []

        def close():
            if platform is not None:
                out.append((platform, state["state"], state["streak"], state["opened"], state["skipped"], state["n"]))

        for batch in batches:
            for p, seconds, ok in zip(batch["platform"], batch["seconds"], batch["ok"], strict=True):
                if p != platform:
                    close()
                    platform, state = p, {"state": "closed", "streak": 0, "opened": 0, "skipped": 0, "n": 0, "until": 0}
                state["n"] += 1
                if state["state"] == "open" and seconds < state["until"]:
                    state["skipped"] += 1
                elif ok:
                    state |= {"state": "closed", "streak": 0}
                else:
                    state["streak"] += 1
                    if state["streak"] >= trip:
                        state |= {"state": "open", "opened": state["opened"] + 1, "until": seconds + 3600 * cooldown_hours}
        close()
        yield pd.DataFrame(out, columns=["platform", "state", "streak", "opened", "skipped", "n"])

    rows = checks.select("platform", F.unix_timestamp("ts").alias("seconds"), "ok", "check_id").repartition("platform").sortWithinPartitions("platform", "seconds", "check_id")
    return rows.select("platform", "seconds", "ok").mapInPandas(fold, "platform string, state string, streak long, opened long, skipped long, n long")
