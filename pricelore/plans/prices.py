"""Queries of offers, prices and timing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelore.operators import prices as op
from pricelore.plans.base import Registry
from pricelore.sources.views import AS_OF, PLATFORMS, Domain, public_sql

registry = Registry()
query = registry.query

PIVOT = ", ".join(f"min(CASE WHEN platform = '{p}' THEN min_price END) AS {p}_price" for p in PLATFORMS[:4])
DAYS = f"""days AS (SELECT product_id, day, {PIVOT}, min(min_price) AS best_price, first(platform ORDER BY min_price, platform) AS best_platform,
  count(DISTINCT platform) AS platform_count, CAST(sum(n) AS BIGINT) AS n FROM platform_days GROUP BY product_id, day)"""
SHOWN = f"shown AS (SELECT * FROM listings WHERE {public_sql()})"
CHOSEN = f"""chosen AS (SELECT * FROM (SELECT l.*, {public_sql("l")} AS priced, l.stock <> 'out_of_stock' AS in_stock, row_number() OVER (PARTITION BY l.product_id, l.platform
  ORDER BY CASE WHEN {public_sql("l")} THEN 0 ELSE 1 END, CASE WHEN l.color = p.color THEN 0 ELSE 2 END,
  CASE WHEN {public_sql("l")} AND l.stock <> 'out_of_stock' THEN 0 ELSE 1 END, l.price, l.last_seen DESC, l.listing_id) AS rn
  FROM {{rows}} l JOIN products p ON p.product_id = l.product_id) WHERE rn = 1)"""


@query(f""", {SHOWN}, by_product AS (SELECT product_id, min(CASE WHEN stock <> 'out_of_stock' THEN price END) AS a,
  first(platform ORDER BY CASE WHEN stock <> 'out_of_stock' THEN 0 ELSE 1 END, price, platform) AS best_platform,
  min(price) AS b, count(DISTINCT platform) AS platform_count, count(*) AS listing_count, max(last_seen) AS last_seen FROM shown GROUP BY product_id)
SELECT p.product_id, category, coalesce(a, b) AS best_price, best_platform, coalesce(platform_count, 0) AS platform_count,
  coalesce(listing_count, 0) AS listing_count, last_seen, a IS NULL AND b IS NOT NULL AS used_fallback
FROM products p LEFT JOIN by_product USING (product_id) WHERE status = 'active'""")
def c1_best_price(d: Domain):
    return op.best_price(d.products, d.listings)


@query(f""", {CHOSEN.format(rows="listings")} SELECT product_id,
  coalesce(min(CASE WHEN in_stock THEN price END), min(price)) AS best_price, first(platform ORDER BY CASE WHEN in_stock THEN 0 ELSE 1 END, price, platform) AS best_platform,
  count(*) AS platform_count, NOT bool_or(in_stock) AS used_fallback FROM chosen WHERE priced GROUP BY product_id""")
def c2_best_unique_price(d: Domain):
    return op.best_unique_price(d.listings, d.products)


@query(f""", rows_shown AS (SELECT * FROM listings WHERE currency = 'INR' AND NOT (platform = 'jiomart' AND category IN ('laptop', 'camera')) AND platform <> 'bajajelectronics'),
{CHOSEN.format(rows="rows_shown")} SELECT product_id, listing_id, platform, price, stock, priced, in_stock,
  row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN priced AND in_stock THEN 0 ELSE 1 END, price, platform) AS position FROM chosen""")
def c3_public_offers(d: Domain):
    return op.public_offers(d.listings, d.products).select("product_id", "listing_id", "platform", "price", "stock", "priced", "in_stock", "position")


@query(f", {SHOWN} SELECT product_id, count(DISTINCT platform) AS offer_count, count(*) AS listing_count FROM shown GROUP BY product_id")
def c4_offer_counts(d: Domain):
    return op.offer_counts(d.listings)


@query("""SELECT listing_id, CAST(date_trunc('month', observed_at) AS DATE) AS period, first(price ORDER BY observed_at, observation_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY observed_at, observation_id) AS close, last(mrp ORDER BY observed_at, observation_id) AS last_mrp, count(*) AS n,
  CAST(sum(CASE WHEN stock = 'in_stock' THEN 1 ELSE 0 END) AS BIGINT) AS n_in_stock FROM observations GROUP BY ALL""")
def c5_listing_ohlc(d: Domain):
    return op.listing_ohlc(d.observations, "month")


@query("SELECT * FROM platform_days")
def c6_platform_days(d: Domain):
    return d.platform_days


@query(f""", {DAYS} SELECT *, min(best_price) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS all_time_low FROM days""")
def c7_product_days(d: Domain):
    return op.product_days(d.platform_days, PLATFORMS[:4])


@query(f""", {DAYS}, all_days AS (SELECT *, min(best_price) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS all_time_low FROM days),
changed AS (SELECT product_id, min(day) AS from_day FROM observations WHERE day >= DATE '2000-01-01' GROUP BY product_id)
SELECT a.* FROM all_days a JOIN changed c ON c.product_id = a.product_id WHERE day >= from_day""")
def c7i_product_days_again(d: Domain):
    changed = d.observations.where(F.col("day") >= F.lit("2000-01-01").cast("date")).select("product_id", "day")
    return op.product_days_again(d.observations, changed, PLATFORMS[:4])


@query(f"""SELECT product_id, day, min(min_price) AS best_price, string_agg(platform || '=' || min_price, ',' ORDER BY platform) AS platform_prices,
  CAST(sum(n_in_stock) AS BIGINT) AS n_in_stock, CAST(sum(n) AS BIGINT) AS n_seen
FROM platform_days WHERE day > DATE '{AS_OF}' - 180 AND day <= DATE '{AS_OF}' GROUP BY product_id, day""")
def c8_price_history(d: Domain):
    rows = op.price_history(d.platform_days, AS_OF, 180)
    entries = F.transform(F.map_entries("platform_prices"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.withColumn("platform_prices", F.array_join(entries, ","))


WINDOWS = {"90d": 90, "1y": 365, "tracked": 3650}
STATS = f"""daily AS (SELECT product_id, day, min(min_price) AS price FROM platform_days WHERE min_price > 0 GROUP BY product_id, day),
windowed AS ({" UNION ALL ".join(f"SELECT *, '{w}' AS win FROM daily WHERE day > DATE '{AS_OF}' - {n} AND day <= DATE '{AS_OF}'" for w, n in WINDOWS.items())}),
ordered AS (SELECT *, lag(price) OVER (PARTITION BY product_id, win ORDER BY day) AS before, row_number() OVER (PARTITION BY product_id, win ORDER BY day DESC) AS back FROM windowed),
lasts AS (SELECT product_id, win, price AS latest, before FROM ordered WHERE back = 1),
stats AS (SELECT o.product_id, o.win AS "window", count(*) AS n, CAST(max(day) - min(day) + 1 AS BIGINT) AS span, min(price) AS low, max(price) AS high, max(latest) AS latest,
  max(latest - l.before) AS change, CASE WHEN count(*) >= 2 THEN round(100.0 * sum(CASE WHEN price <= latest THEN 1 ELSE 0 END) / count(*), 1) END AS percentile,
  CASE WHEN count(*) >= 3 THEN round(stddev_pop(price) / avg(price), 4) END AS volatility
  FROM ordered o JOIN lasts l ON l.product_id = o.product_id AND l.win = o.win GROUP BY o.product_id, o.win)"""


@query(f", {STATS} SELECT * FROM stats")
def c9_window_stats(d: Domain):
    return op.window_stats(op.daily_best(d.platform_days), AS_OF, WINDOWS)


STATES = f"""{SHOWN}, offers AS (SELECT product_id, count(DISTINCT platform) AS stores, count(DISTINCT CASE WHEN stock <> 'out_of_stock' THEN platform END) AS stores_in_stock,
  min(CASE WHEN stock <> 'out_of_stock' THEN price END) AS current,
  min(greatest(CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(last_seen)) / 3600) AS BIGINT), 0)) AS hours FROM shown GROUP BY product_id),
joined AS (SELECT p.product_id, stores, stores_in_stock, current, hours, coalesce(a.n >= 7, false) AS enough,
  CASE WHEN coalesce(a.n >= 7, false) THEN a.n ELSE t.n END AS n, CASE WHEN coalesce(a.n >= 7, false) THEN a.span ELSE t.span END AS span,
  CASE WHEN coalesce(a.n >= 7, false) THEN a.low ELSE t.low END AS low, CASE WHEN coalesce(a.n >= 7, false) THEN a.latest ELSE t.latest END AS latest,
  CASE WHEN coalesce(a.n >= 7, false) THEN a.change ELSE t.change END AS change
  FROM products p LEFT JOIN offers o ON o.product_id = p.product_id LEFT JOIN stats a ON a.product_id = p.product_id AND a."window" = '90d'
  LEFT JOIN stats t ON t.product_id = p.product_id AND t."window" = 'tracked'),
coded AS (SELECT *, CASE WHEN coalesce(stores, 0) = 0 THEN 'NO_PRICED_OFFERS' WHEN stores_in_stock = 0 THEN 'OOS_ONLY' WHEN current IS NULL THEN 'NO_IN_STOCK_PRICE'
  WHEN coalesce(n, 0) < 7 OR coalesce(span, 0) < 14 THEN 'INSUFFICIENT_HISTORY' WHEN hours > 24 * 400 THEN 'STALE_OFFERS'
  WHEN (current - low) / CAST(low AS DOUBLE) <= 0.03 AND stores_in_stock >= 2 THEN 'NEAR_RECENT_LOW'
  WHEN (current - low) / CAST(low AS DOUBLE) >= 0.08 AND coalesce(change < 0 AND (-change >= 10000 OR -change * 100 >= (latest - change) * 2), false) THEN 'RECENT_DROP_ABOVE_LOW'
  WHEN (current - low) / CAST(low AS DOUBLE) >= 0.08 THEN 'ABOVE_RECENT_LOW' ELSE 'WATCH' END AS code FROM joined),
signals AS (SELECT product_id, CASE WHEN code IN ('NO_PRICED_OFFERS', 'OOS_ONLY', 'NO_IN_STOCK_PRICE') THEN 'UNAVAILABLE' WHEN code = 'INSUFFICIENT_HISTORY' THEN code
  WHEN code = 'NEAR_RECENT_LOW' THEN 'CONSIDER_NOW' WHEN code = 'ABOVE_RECENT_LOW' THEN 'WAIT_FOR_BETTER_PRICE' ELSE 'WATCH' END AS state, code,
  CASE WHEN enough THEN '90d' ELSE 'tracked' END AS evidence, coalesce(stores, 0) AS stores, coalesce(stores_in_stock, 0) AS stores_in_stock, current, low FROM coded)"""


@query(f", {STATS}, {STATES} SELECT * FROM signals")
def c10_timing(d: Domain):
    stats = op.window_stats(op.daily_best(d.platform_days), AS_OF, WINDOWS)
    return op.timing(d.products, op.offer_state(d.listings, AS_OF), stats, stale_hours=24 * 400)


@query(f""", {STATS}, {STATES}, coded_rows AS (SELECT product_id, state, CASE WHEN state = 'CONSIDER_NOW' AND stores_in_stock = 0 THEN 1 ELSE 0 END + CASE WHEN state = 'CONSIDER_NOW' AND low IS NULL THEN 1 ELSE 0 END
  + CASE WHEN state = 'CONSIDER_NOW' AND current * 100 > low * 103 THEN 1 ELSE 0 END + CASE WHEN state = 'WAIT_FOR_BETTER_PRICE' AND current <= low THEN 1 ELSE 0 END
  + CASE WHEN state = 'UNAVAILABLE' AND stores_in_stock > 0 THEN 1 ELSE 0 END + CASE WHEN stores_in_stock > stores THEN 1 ELSE 0 END
  + CASE WHEN current < low THEN 1 ELSE 0 END + CASE WHEN current IS NOT NULL AND stores_in_stock = 0 THEN 1 ELSE 0 END AS n_codes FROM signals)
SELECT product_id, state, CAST(n_codes AS BIGINT) AS n_codes FROM coded_rows""")
def c11_contradictions(d: Domain):
    return op.contradictions(c10_timing(d)).select("product_id", "state", F.size("codes").cast("long").alias("n_codes"))


@query(f""", {SHOWN}, daily AS (SELECT product_id, day, min(min_price) AS price FROM platform_days WHERE min_price > 0 GROUP BY product_id, day),
st AS (SELECT product_id, count(*) AS n, min(price) AS low, max(price) AS high, avg(price) AS mean FROM daily GROUP BY product_id),
cur AS (SELECT product_id, min(price) AS price FROM shown GROUP BY product_id)
SELECT product_id, n, low, high, price, CASE WHEN n < 3 THEN 'Limited data' WHEN price <= low * CAST(1.03 AS DOUBLE) THEN 'Near observed low' WHEN price > mean * CAST(1.08 AS DOUBLE) THEN 'Above recent average' ELSE 'Typical' END AS label
FROM cur JOIN st USING (product_id)""")
def c50_insight(d: Domain):
    current = d.listings.where(op.public_priced(d.listings)).groupBy("product_id").agg(F.min("price").alias("price"))
    return op.insight(op.daily_best(d.platform_days), current)


@query("""SELECT observation_id, listing_id, product_id, platform, observed_at, price, before AS previous, stock,
  CASE WHEN stock_before IS NULL THEN 'initial' WHEN stock = 'out_of_stock' AND stock_before <> 'out_of_stock' THEN 'out_of_stock'
  WHEN stock <> 'out_of_stock' AND stock_before = 'out_of_stock' THEN 'back_in_stock' WHEN price < before THEN 'drop' WHEN price > before THEN 'rise' ELSE 'unchanged' END AS kind
FROM (SELECT *, lag(price) OVER w AS before, lag(stock) OVER w AS stock_before FROM observations WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, observation_id))""")
def w4_price_events(d: Domain):
    return op.price_events(d.observations)
