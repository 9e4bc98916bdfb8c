"""Queries of scheduling, queue, health and freshness, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelore.operators import scheduling as op
from pricelore.plans.base import Registry
from pricelore.sources.views import AS_OF, CATEGORIES, EVENTS_AS_OF, PLATFORMS, Domain

registry = Registry()
query = registry.query

NOW, EVENTS_NOW = f"TIMESTAMP '{AS_OF} 00:00:00'", f"TIMESTAMP '{EVENTS_AS_OF}'"
DEMAND = "demand AS (SELECT product_id, count(*) AS n FROM activity GROUP BY product_id)"
COVERAGE = "coverage AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}')" for p in PLATFORMS for c in CATEGORIES if (p, c) not in (("jiomart", "laptop"), ("jiomart", "camera")) and p != "bajajelectronics") + ") v(platform, category))"


def age(ts: str, now: str = NOW) -> str:
    return f"((epoch({now}) - epoch({ts})) / 3600.0)"


def demand(d: Domain):
    return d.activity.groupBy("product_id").agg(F.count("*").alias("n"))


def coverage(d: Domain):
    rows = [(p, c) for p in PLATFORMS for c in CATEGORIES if (p, c) not in (("jiomart", "laptop"), ("jiomart", "camera")) and p != "bajajelectronics"]
    return d.spark.createDataFrame(rows, "platform string, category string")


@query(f""", {DEMAND}, open_tasks AS (SELECT DISTINCT platform, task_id % 2000 AS product_id FROM tasks WHERE status IN ('pending', 'running')),
tiers AS (SELECT l.*, CASE WHEN n >= 100 THEN 'hot' WHEN n >= 50 THEN 'normal' ELSE 'cold' END AS tier FROM listings l LEFT JOIN demand d ON d.product_id = l.product_id
  WHERE NOT EXISTS (SELECT 1 FROM open_tasks o WHERE o.platform = l.platform AND o.product_id = l.product_id)),
due AS (SELECT * FROM tiers WHERE {age("last_seen")} >= CASE tier WHEN 'hot' THEN 2000 WHEN 'normal' THEN 5000 ELSE 10000 END)
SELECT listing_id, platform, tier, row_number() OVER (PARTITION BY platform ORDER BY CASE tier WHEN 'hot' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, last_seen, listing_id) AS platform_rank FROM due""")
def q1_refresh_due(d: Domain):
    open_tasks = d.tasks.where("status in ('pending', 'running')").select("platform", (F.col("task_id") % 2000).alias("product_id")).distinct()
    return op.refresh_due(d.listings, demand(d), open_tasks, AS_OF, 2000, 5000, 10000).select("listing_id", "platform", "tier", "platform_rank")


@query(f"""SELECT task_id AS plan_id, CAST(floor({age("scheduled_at")} * 60) AS BIGINT) - priority * 1000000 AS late_minutes FROM tasks WHERE attempts <> 0 AND CAST(floor({age("scheduled_at")} * 60) AS BIGINT) - priority * 1000000 >= 0""")
def q2_due_plans(d: Domain):
    plans = d.tasks.select(F.col("task_id").alias("plan_id"), (F.col("priority") * 1_000_000).alias("cadence_minutes"), F.col("scheduled_at").alias("last_run"), (F.col("attempts") != 0).alias("enabled"))
    return op.due_plans(plans, AS_OF)


@query(f"""SELECT task_id, status, CASE WHEN status = 'running' AND attempts >= 3 THEN 'dead' WHEN status = 'running' THEN 'pending' ELSE status END AS new_status,
  CASE WHEN status = 'running' THEN CAST(least(360, 5 * power(3, greatest(attempts - 1, 0))) AS BIGINT) END AS delay_minutes FROM tasks""")
def q3_requeue_stuck(d: Domain):
    return op.requeue_stuck(d.tasks, AS_OF).select("task_id", "status", "new_status", "delay_minutes")


@query("""SELECT l.product_id, min(platform) AS platform, last(price ORDER BY last_seen, listing_id) AS price, CAST(floor(min((epoch(TIMESTAMP '2001-11-05 00:00:00') - epoch(last_seen)) / 3600.0)) AS BIGINT) AS hours
FROM listings l GROUP BY l.product_id HAVING count(DISTINCT platform) = 1""")
def q4_single_store(d: Domain):
    return op.single_store(d.listings, AS_OF)


@query(f", {COVERAGE} SELECT p.product_id, c.platform, p.category FROM products p JOIN coverage c ON c.category = p.category WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.product_id = p.product_id AND l.platform = c.platform)")
def q5_missing_platforms(d: Domain):
    return op.missing_platforms(d.listings, d.products, coverage(d))


@query(f""", {COVERAGE}, missing AS (SELECT p.product_id, c.platform FROM products p JOIN coverage c ON c.category = p.category WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.product_id = p.product_id AND l.platform = c.platform))
SELECT * FROM missing m WHERE NOT EXISTS (SELECT 1 FROM checks c WHERE c.product_id = m.product_id AND c.platform = m.platform AND {age("c.ts", EVENTS_NOW)} < 168)""")
def q6_cooled_down(d: Domain):
    missing = op.missing_platforms(d.listings, d.products, coverage(d)).select("product_id", "platform")
    return op.cooled_down(missing, d.checks.select("product_id", "platform", F.col("ts").alias("at")), EVENTS_AS_OF)


@query("""SELECT platform, CAST(scheduled_at AS DATE) AS day, count(*) AS used, greatest(2 - count(*), 0) AS "left", count(*) < 2 AS available FROM tasks WHERE status <> 'dead' GROUP BY platform, CAST(scheduled_at AS DATE)""")
def q8_budget(d: Domain):
    limits = d.spark.createDataFrame([(p, 2) for p in PLATFORMS], "platform string, daily_limit long")
    return op.budget(d.tasks, limits)


@query()
def q9_circuit_breaker(d: Domain):
    return op.circuit_breaker(d.checks)


@query(f"""SELECT platform, {", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s}" for s in ("pending", "running", "completed", "dead"))},
  max(CASE WHEN status = 'pending' THEN CAST(floor({age("scheduled_at")}) AS BIGINT) END) AS oldest_hours, CAST(sum(CASE WHEN status = 'dead' AND {age("scheduled_at")} <= 8760 THEN 1 ELSE 0 END) AS BIGINT) AS n_dead_recent FROM tasks GROUP BY platform""")
def q10_queue_state(d: Domain):
    return op.queue_state(d.tasks, AS_OF)


@query(f"SELECT task_id, platform, priority, scheduled_at FROM tasks WHERE status = 'pending' AND scheduled_at <= {NOW} ORDER BY priority, scheduled_at, created_at, task_id LIMIT 50")
def t5_claim_order(d: Domain):
    return op.claim_order(d.tasks, AS_OF, 50).select("task_id", "platform", "priority", "scheduled_at")


@query(f"""SELECT platform, count(*) AS n, percentile_cont(0.5) WITHIN GROUP (ORDER BY CASE WHEN ok THEN CAST(latency AS DOUBLE) END) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY CASE WHEN ok THEN CAST(latency AS DOUBLE) END) AS p95,
  round(100.0 * sum(CASE WHEN ok THEN 0 ELSE 1 END) / count(*), 2) AS fail_percent, CAST(floor(min({age("ts", EVENTS_NOW)})) AS BIGINT) AS hours_since FROM checks WHERE {age("ts", EVENTS_NOW)} < 168 GROUP BY platform""")
def q11_check_latency(d: Domain):
    return op.check_latency(d.checks, EVENTS_AS_OF)


@query(f"""SELECT category, count(*) AS n, {", ".join(f"CAST(sum(CASE WHEN {age('last_seen')} <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS within_{b}h" for b in (24, 720, 8760))},
  CAST(sum(CASE WHEN {age("last_seen")} > 8760 THEN 1 ELSE 0 END) AS BIGINT) AS stale, CAST(sum(CASE WHEN match_status = 'needs_review' THEN 1 ELSE 0 END) AS BIGINT) AS needs_review FROM listings GROUP BY category""")
def q12_freshness(d: Domain):
    return op.freshness(d.listings, AS_OF)


@query("SELECT platforms, count(*) AS n FROM (SELECT product_id, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM listings GROUP BY product_id) GROUP BY platforms")
def q13_platform_pairs(d: Domain):
    return op.platform_pairs(d.listings)


@query(f""", {COVERAGE}, by_pair AS (SELECT platform, category, count(*) AS n, sum(CASE WHEN price > 0 AND stock = 'in_stock' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN match_status = 'matched' THEN 1 ELSE 0 END) AS m FROM listings GROUP BY platform, category)
SELECT c.platform, c.category, coalesce(n, 0) AS n, CAST(coalesce(b, 0) AS BIGINT) AS n_buyable, CAST(coalesce(m, 0) AS BIGINT) AS n_matched,
  CASE WHEN n IS NULL THEN 'EMPTY' WHEN n < 20 THEN 'THIN' WHEN b * 100 >= n * 60 AND m * 100 >= n * 85 THEN 'READY' ELSE 'LIMITED' END AS state FROM coverage c LEFT JOIN by_pair b ON b.platform = c.platform AND b.category = c.category""")
def q14_readiness(d: Domain):
    return op.readiness(d.listings, coverage(d))


@query(f""", {DEMAND} SELECT l.listing_id, l.product_id FROM listings l WHERE {age("last_seen")} > 24 AND EXISTS (SELECT 1 FROM demand d WHERE d.product_id = l.product_id AND n >= 50) AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.task_id = l.listing_id % 1000 AND status = 'dead')""")
def q15_stale_hot(d: Domain):
    listings = d.listings.withColumn("task_id", F.col("listing_id") % 1000)
    known = listings.join(d.tasks.where("status = 'dead'").select("task_id"), "task_id", "left_semi").select("listing_id")
    return op.stale_hot(d.listings, demand(d), known, AS_OF).select("listing_id", "product_id")


@query(f""", firsts AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY stock <> 'out_of_stock' DESC, price, listing_id) AS rn, n_seen % 4 AS failures, listing_id % 11 = 0 AS running FROM listings)
SELECT product_id, listing_id, price, CASE WHEN running THEN 'busy' WHEN {age("last_seen")} < 2000 THEN 'fresh' WHEN failures > 0 AND {age("last_seen")} < least(64, power(2, least(failures, 8))) * 6000 THEN 'cooldown' ELSE 'due' END AS state FROM firsts WHERE rn = 1""")
def q16_admission(d: Domain):
    offers = d.listings.select("product_id", "listing_id", "price", (F.col("stock") != "out_of_stock").alias("in_stock"), "last_seen", (F.col("n_seen") % 4).alias("failures"), (F.col("listing_id") % 11 == 0).alias("running"))
    return op.admission(offers, AS_OF, fresh=2000, cooldown=6000)


@query("SELECT platform, count(*) AS n_listings, count(DISTINCT product_id) AS n_products, min(price) AS low, max(price) AS high, max(last_seen) AS last_seen FROM listings GROUP BY platform")
def q18_platform_summary(d: Domain):
    return d.listings.groupBy("platform").agg(F.count("*").alias("n_listings"), F.count_distinct("product_id").alias("n_products"), F.min("price").alias("low"), F.max("price").alias("high"), F.max("last_seen").alias("last_seen"))
