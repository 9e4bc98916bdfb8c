"""Queries of audits, quality, watches and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelore.operators import prices
from pricelore.operators import reports as op
from pricelore.plans.base import Registry
from pricelore.plans.catalog import BEST, best
from pricelore.plans.rails import DAILY
from pricelore.sources.views import PLATFORMS, Domain

registry = Registry()
query = registry.query

EVENTS = """moves AS (SELECT *, lag(price) OVER w AS previous, lag(stock) OVER w AS stock_before FROM observations WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, observation_id)),
kinds AS (SELECT *, CASE WHEN stock_before IS NULL THEN 'initial' WHEN stock = 'out_of_stock' AND stock_before <> 'out_of_stock' THEN 'out_of_stock'
  WHEN stock <> 'out_of_stock' AND stock_before = 'out_of_stock' THEN 'back_in_stock' WHEN price < previous THEN 'drop' WHEN price > previous THEN 'rise' ELSE 'unchanged' END AS kind FROM moves)"""


@query("""SELECT title, product_id AS retired, survivor, rn - 1 AS place FROM (SELECT title, product_id, row_number() OVER w AS rn, first_value(product_id) OVER w AS survivor FROM products WINDOW w AS (PARTITION BY title ORDER BY size DESC, product_id)) WHERE rn > 1""")
def r1_duplicate_titles(d: Domain):
    return op.duplicate_groups(d.products, "title", [F.desc("size"), F.asc("product_id")], "product_id")


@query("SELECT product_id, category FROM products p WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.product_id = p.product_id)")
def r2_orphans(d: Domain):
    return op.orphans(d.products.select("product_id", "category"), d.listings)


@query("""SELECT category, count(*) AS n, CAST(sum(CASE WHEN k >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS at_least_1, CAST(sum(CASE WHEN k >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS at_least_20, CAST(sum(CASE WHEN k >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS at_least_30,
  percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(k AS DOUBLE)) AS median FROM (SELECT category, product_id, count(*) AS k FROM listings GROUP BY category, product_id) GROUP BY category""")
def r3_listing_ladder(d: Domain):
    return op.ladder_counts(d.listings.groupBy("category", "product_id").agg(F.count("*").alias("k")), "category", "k", (1, 20, 30))


@query(f""", {BEST}, least AS (SELECT product_id, min(price) AS least FROM listings GROUP BY product_id)
SELECT b.product_id, best_price, least, CASE WHEN best_price IS NULL THEN 'no_best' WHEN best_price > least THEN 'above_least' ELSE 'below_least' END AS kind FROM best b LEFT JOIN least l ON l.product_id = b.product_id WHERE best_price IS DISTINCT FROM least""")
def r4_price_mismatches(d: Domain):
    return op.price_mismatches(best(d), d.listings)


@query("""SELECT product_id, 'color' AS key, count(DISTINCT color) AS n_values FROM listings GROUP BY product_id HAVING count(DISTINCT color) > 1
UNION ALL SELECT product_id, 'currency', count(DISTINCT currency) FROM listings GROUP BY product_id HAVING count(DISTINCT currency) > 1""")
def r6_suspect_clusters(d: Domain):
    return op.suspect_clusters(d.listings, ("color", "currency"))


@query("""SELECT *, CASE WHEN n_colors = n THEN 'colours' WHEN n_prices = 1 THEN 'same_price' ELSE 'mixed' END AS cause FROM (SELECT product_id, platform, count(*) AS n, count(DISTINCT color) AS n_colors, count(DISTINCT price) AS n_prices FROM listings GROUP BY product_id, platform) WHERE n > 1""")
def r7_same_platform_duplicates(d: Domain):
    return op.same_platform_duplicates(d.listings)


@query("SELECT CAST(size // 8 * 8 AS BIGINT) AS band, count(*) AS n FROM products GROUP BY ALL")
def a15_size_bands(d: Domain):
    return op.bands(d.products, "size", 8)


@query("""SELECT CAST(b AS INTEGER) AS bound, CAST(sum(CASE WHEN b IS NULL OR latency <= b THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(latency) AS BIGINT) AS total FROM checks, (VALUES (100), (1000), (5000), (20000), (NULL)) v(b) GROUP BY b""")
def a20_latency_buckets(d: Domain):
    return op.buckets(d.checks, "latency", (100, 1000, 5000, 20000))


@query("""SELECT *, round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 4) AS "precision", round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 4) AS recall FROM (SELECT CAST(sum(CASE WHEN quality = 1 AND n_chars > 500 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN quality <> 1 AND n_chars > 500 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN quality = 1 AND n_chars <= 500 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN quality <> 1 AND n_chars <= 500 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)""")
def a21_precision_recall(d: Domain):
    rows = d.table("labels").join(d.table("documents").select("doc_id", "n_chars"), "doc_id")
    return op.precision_recall(rows.withColumn("predicted", (F.col("n_chars") > 500).cast("int")), "quality", "predicted")


@query("""SELECT listing_id, product_id, concat_ws(',', CASE WHEN NOT price BETWEEN 100 AND 1000000 THEN 'price_out_of_bounds' END, CASE WHEN mrp < price THEN 'mrp_below_price' END, CASE WHEN mrp > price * 10 THEN 'discount_suspicious' END,
  CASE WHEN rn > 1 THEN 'duplicate_offer' END, CASE WHEN match_status = 'needs_review' THEN 'needs_review' END) AS flags,
  CASE WHEN NOT price BETWEEN 100 AND 1000000 OR rn > 1 THEN 'rejected' WHEN mrp < price OR mrp > price * 10 OR match_status = 'needs_review' THEN 'degraded' ELSE 'accepted' END AS decision,
  price BETWEEN 100 AND 1000000 AND mrp >= price AS price_usable
FROM (SELECT l.*, row_number() OVER (PARTITION BY title, platform, price ORDER BY listing_id) AS rn FROM listings l JOIN products p ON p.product_id = l.product_id)""")
def c45_quality_gate(d: Domain):
    return op.quality_gate(d.listings.join(d.products.select("product_id", "title"), "product_id"))


@query(f", {EVENTS} SELECT observation_id, listing_id, previous, price, CASE WHEN price * 100 < previous * 30 THEN 'drop' ELSE 'spike' END AS flag FROM kinds WHERE previous > 0 AND (price * 100 < previous * 30 OR price > previous * 3)")
def c46_refresh_checks(d: Domain):
    return op.refresh_checks(prices.price_events(d.observations))


@query(f""", {EVENTS}, w AS (SELECT user_id, product_id % 2000 AS product_id, min(target) AS target, bool_or(notify_on_drop) AS notify_on_drop FROM watches GROUP BY user_id, product_id % 2000),
joined AS (SELECT w.*, price, previous, stock, kind FROM w JOIN kinds k ON k.product_id = w.product_id),
hits AS (SELECT *, 'AT_TARGET' AS event FROM joined WHERE stock <> 'out_of_stock' AND price <= target AND (previous IS NULL OR previous > target)
  UNION ALL SELECT *, 'PRICE_DROP' FROM joined WHERE notify_on_drop AND stock <> 'out_of_stock' AND previous - price > 0 AND ((previous - price) * 50 >= previous OR previous - price >= 50000)
  UNION ALL SELECT *, 'BACK_IN_STOCK' FROM joined WHERE kind = 'back_in_stock' UNION ALL SELECT *, 'OUT_OF_STOCK' FROM joined WHERE kind = 'out_of_stock')
SELECT DISTINCT user_id, product_id, event, price, previous, stock, sha256(user_id || '|' || product_id || '|' || event || '|' || price || '|' || coalesce(CAST(previous AS VARCHAR), '') || '|' || stock) AS fingerprint FROM hits""")
def c48_watch_events(d: Domain):
    watches = d.watches.groupBy("user_id", (F.col("product_id") % 2000).alias("product_id")).agg(F.min("target").alias("target"), F.bool_or("notify_on_drop").alias("notify_on_drop"))
    return op.watch_events(watches, prices.price_events(d.observations))


@query(f""", {BEST.replace("FROM products p JOIN shown", ", min(CASE WHEN stock <> 'out_of_stock' THEN price END) IS NULL AS used_fallback FROM products p JOIN shown")}, {EVENTS},
latest AS (SELECT product_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, observation_id DESC) AS rn FROM kinds) WHERE rn = 1),
w AS (SELECT user_id, product_id % 2000 AS product_id, target, notify_on_drop FROM watches)
SELECT user_id, w.product_id, target, best_price, CASE WHEN best_price IS NULL THEN 'UNAVAILABLE' WHEN used_fallback THEN 'OUT_OF_STOCK' WHEN best_price <= target THEN 'AT_TARGET' WHEN kind = 'back_in_stock' THEN 'BACK_IN_STOCK'
  WHEN kind = 'drop' AND notify_on_drop THEN 'DROPPED' WHEN best_price * 100 <= target * 110 THEN 'NEAR_TARGET' ELSE 'WATCHING' END AS state FROM w LEFT JOIN best b ON b.product_id = w.product_id LEFT JOIN latest l ON l.product_id = w.product_id""")
def c49_watch_states(d: Domain):
    watches = d.watches.withColumn("product_id", F.col("product_id") % 2000)
    return op.watch_states(watches, best(d), op.latest_event(prices.price_events(d.observations)))


@query("""SELECT listing_id, last(price ORDER BY observed_at, observation_id) AS price, last(stock ORDER BY observed_at, observation_id) AS stock, min(observed_at) AS first_seen, max(observed_at) AS last_seen
FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, observed_at ORDER BY observation_id DESC) AS rn FROM observations) WHERE rn = 1 GROUP BY listing_id""")
def s10_upsert(d: Domain):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("listing_id", "observed_at").orderBy(F.desc("observation_id")))
    rows = d.observations.withColumn("rn", rn).where("rn = 1").select("listing_id", "price", "stock", "observed_at")
    middle = F.lit("1998-06-01").cast("timestamp_ntz")
    return op.upsert(rows.where(F.col("observed_at") < middle), rows.where(F.col("observed_at") >= middle), "listing_id", "observed_at")


@query("SELECT DISTINCT product_id FROM observations o WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = o.product_id AND status = 'active')")
def s11_insert_absent(d: Domain):
    return op.insert_absent(d.products.where("status = 'active'").select("product_id"), d.observations.select("product_id"), "product_id")


@query("""SELECT o.observation_id, o.listing_id FROM observations o WHERE observed_at >= TIMESTAMP '2000-01-01' OR observation_id IN (SELECT max(observation_id) FROM observations GROUP BY listing_id)""")
def s15_retention(d: Domain):
    """Old observations go, but for each listing's last one."""
    o = d.observations.select("observation_id", "listing_id", "observed_at")
    last = o.groupBy("listing_id").agg(F.max("observation_id").alias("observation_id"))
    recent = F.col("observed_at") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return o.where(recent).select("observation_id", "listing_id").unionByName(o.where(~recent).join(last.select("observation_id"), "observation_id", "left_semi").select("observation_id", "listing_id"))


@query(f""", {DAILY}, chosen AS (SELECT product_id, platform, min(price) AS price FROM listings GROUP BY product_id, platform)
SELECT p.product_id, (SELECT string_agg(platform || ':' || price, ',' ORDER BY platform) FROM chosen c WHERE c.product_id = p.product_id) AS platforms,
  (SELECT count(*) FROM daily x WHERE x.product_id = p.product_id) AS n_history, (SELECT CAST(sum(price) AS BIGINT) FROM daily x WHERE x.product_id = p.product_id) AS history_sum FROM products p""")
def s6_nested_export(d: Domain):
    offers = d.listings.groupBy("product_id", "platform").agg(F.min("price").alias("price")).withColumn("stock", F.lit("in_stock"))
    days = prices.daily_best(d.platform_days).withColumnRenamed("price", "best_price")
    rows = op.nested_export(d.products.select("product_id"), offers, days)
    entries = F.transform(F.map_entries("platforms"), lambda e: F.concat_ws(":", e["key"], e["value"]["price"].cast("string")))
    return rows.select("product_id", F.array_join(entries, ",").alias("platforms"), F.when(F.col("history").isNull(), 0).otherwise(F.size("history")).cast("long").alias("n_history"), F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x["best_price"]).alias("history_sum"))


@query(f"""SELECT product_id, {", ".join(f"min(CASE WHEN platform = '{p}' THEN price END) AS {p}" for p in PLATFORMS)} FROM listings GROUP BY product_id""")
def a6_platform_pivot(d: Domain):
    return d.listings.groupBy("product_id").pivot("platform", list(PLATFORMS)).agg(F.min("price"))


@query("""SELECT user_id AS client_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS n_types, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 2""")
def a7_client_summary(d: Domain):
    e = d.table("events")
    by = e.groupBy(F.col("user_id").alias("client_id")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("event_type").alias("n_types"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    return by.where("n_types >= 2")


@query("SELECT DISTINCT day FROM observations WHERE stock = 'out_of_stock' UNION SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P'")
def u1_affected_days(d: Domain):
    o = d.table("orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day"))
    return d.observations.where("stock = 'out_of_stock'").select("day").union(o).distinct()


@query("SELECT product_id, category, best_price, CAST((rn - 1) // 100 AS BIGINT) AS page FROM (SELECT product_id, category, size * 100 AS best_price, row_number() OVER (ORDER BY product_id) AS rn FROM products WHERE status = 'active')")
def s14_pages(d: Domain):
    rows = d.products.where("status = 'active'").select("product_id", "category", (F.col("size") * 100).alias("best_price"))
    return op.numbered(rows, "product_id").select("product_id", "category", "best_price", F.floor((F.col("number") - 1) / 100).alias("page"))
