"""Queries of the home page's rails, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelore.operators import prices, rails
from pricelore.plans.base import Registry
from pricelore.sources.views import CATEGORIES, Domain, public_sql

registry = Registry()
query = registry.query

SHOWN = f"shown AS (SELECT * FROM listings WHERE {public_sql()})"
DAILY = "daily AS (SELECT product_id, day, min(min_price) AS price FROM platform_days WHERE min_price > 0 GROUP BY product_id, day)"
BEST = f"""{SHOWN}, best AS (SELECT p.product_id, p.category, coalesce(min(CASE WHEN stock <> 'out_of_stock' THEN price END), min(price)) AS best_price,
  count(DISTINCT platform) AS platform_count FROM products p JOIN shown s ON s.product_id = p.product_id WHERE status = 'active' GROUP BY p.product_id, p.category)"""
TRACKED = "tracked AS (SELECT product_id, min(price) AS low, count(*) AS n, count(DISTINCT day) AS days, max(day) - min(day) + 1 AS span FROM daily GROUP BY product_id)"
DROPS = """ordered AS (SELECT *, lag(price) OVER w AS previous, lag(day) OVER w AS previous_day, lead(day) OVER w AS next_day FROM daily WINDOW w AS (PARTITION BY product_id ORDER BY day)),
drops AS (SELECT o.product_id, day, price, previous, previous - price AS "drop", round(100.0 * (previous - price) / previous, 2) AS percent, category
  FROM ordered o JOIN products p ON p.product_id = o.product_id WHERE status = 'active' AND next_day IS NULL AND previous_day >= day - 90 AND previous > price
  AND (round(100.0 * (previous - price) / previous, 2) >= 2 OR previous - price >= 10000))"""
DISCOUNTS = f"""{SHOWN}, discounts AS (SELECT product_id, category, listing_id, platform, price, mrp, discount FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY discount DESC, price, listing_id) AS rn FROM (SELECT *, round((mrp - price) / CAST(mrp AS DOUBLE), 4) AS discount FROM shown WHERE mrp > 0)
  WHERE discount >= 0.05 AND discount < 0.9) WHERE rn = 1)"""
NEAR = f"{BEST}, {DAILY}, {TRACKED}, near AS (SELECT b.product_id, category, best_price, low, round(100.0 * (best_price - low) / low, 1) AS gap_percent FROM best b JOIN tracked t ON t.product_id = b.product_id WHERE best_price > low AND best_price * 100 <= low * 105 AND n >= 7 AND span >= 14)"


def best(d: Domain):
    return prices.best_price(d.products, d.listings).where("platform_count > 0")


def drops(d: Domain):
    return rails.price_drops(prices.daily_best(d.platform_days), d.products, max_gap_days=90)


@query(f", {DAILY}, {DROPS} SELECT * FROM drops")
def c12_price_drops(d: Domain):
    return drops(d)


@query(f", {DISCOUNTS} SELECT * FROM discounts")
def c13_biggest_discounts(d: Domain):
    return rails.biggest_discounts(d.listings)


@query(f", {BEST}, {DAILY}, {TRACKED} SELECT b.product_id, category, best_price, low, days FROM best b JOIN tracked t ON t.product_id = b.product_id WHERE best_price <= low AND n >= 2 AND days >= 2")
def c14_at_tracked_low(d: Domain):
    return rails.at_tracked_low(best(d), prices.daily_best(d.platform_days))


@query(f", {NEAR} SELECT * FROM near")
def c15_near_tracked_low(d: Domain):
    return rails.near_tracked_low(best(d), prices.daily_best(d.platform_days))


@query(f""", {BEST} SELECT product_id, category, best_price, platform_count FROM best
WHERE platform_count >= 2 AND (platform_count >= 7 OR (SELECT count(*) FROM best WHERE platform_count >= 7) < 12)""")
def c16_multi_store(d: Domain):
    return rails.multi_store(best(d), 12, preferred=7).select("product_id", "category", "best_price", "platform_count")


@query(f""", {SHOWN} SELECT product_id, category, last_seen, rn AS position FROM (SELECT product_id, category, max(last_seen) AS last_seen,
  row_number() OVER (PARTITION BY category ORDER BY max(last_seen) DESC, product_id) AS rn FROM shown GROUP BY product_id, category) WHERE rn <= 10""")
def c17_recently_checked(d: Domain):
    from pyspark.sql import Window

    by = d.listings.where(prices.public_priced(d.listings)).groupBy("product_id", "category").agg(F.max("last_seen").alias("last_seen"))
    rn = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("last_seen"), "product_id"))
    return by.withColumn("position", rn.cast("long")).where("position <= 10")


PICK = """picked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY percent DESC, product_id) AS rn FROM drops),
diverse AS (SELECT *, row_number() OVER (ORDER BY rn > 3, CASE WHEN rn <= 3 THEN rn END NULLS LAST, category, rn) AS position FROM picked)"""


@query(f", {DAILY}, {DROPS}, {PICK} SELECT product_id, category, percent, position FROM diverse WHERE position <= 12")
def w10_diverse_drops(d: Domain):
    return rails.diverse(drops(d), [F.desc("percent"), F.asc("product_id")], 12).select("product_id", "category", "percent", "position")


@query(f", {DAILY}, {DROPS} SELECT product_id, category, percent, row_number() OVER (PARTITION BY category ORDER BY percent DESC, product_id) AS turn, list_position([{', '.join(repr(c) for c in CATEGORIES)}], category) AS group_rank FROM drops")
def w9_interleaved_drops(d: Domain):
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    return rails.interleaved(drops(d), "category", [F.desc("percent"), F.asc("product_id")], rank).select("product_id", "category", "percent", "turn", "group_rank")


RAILS = f"""{DAILY}, {DROPS}, {DISCOUNTS}, {NEAR.replace(SHOWN + ", ", "").replace(DAILY + ", ", "")},
rails AS (SELECT 1 AS rail, product_id, row_number() OVER (ORDER BY percent DESC, product_id) AS position FROM drops
  UNION ALL SELECT 2, product_id, row_number() OVER (ORDER BY discount DESC, product_id) FROM discounts
  UNION ALL SELECT 3, product_id, row_number() OVER (ORDER BY gap_percent, product_id) FROM near
  UNION ALL SELECT 4, product_id, row_number() OVER (ORDER BY platform_count DESC, product_id) FROM best),
cut AS (SELECT rail, position, product_id FROM rails WHERE position <= 20)"""


def home(d: Domain):
    """The first 20 products of four rails: rail, position, product_id."""
    daily, found = prices.daily_best(d.platform_days), best(d)
    parts = [(1, drops(d), F.desc("percent")), (2, rails.biggest_discounts(d.listings), F.desc("discount")), (3, rails.near_tracked_low(found, daily), F.asc("gap_percent")), (4, found, F.desc("platform_count"))]
    out = None
    for rail, rows, order in parts:
        top = rails.numbered(rows.orderBy(order, "product_id").limit(20), [order, F.asc("product_id")]).select(F.lit(rail).alias("rail"), "position", "product_id")
        out = top if out is None else out.unionByName(top)
    return out


@query(f""", {RAILS}, marked AS (SELECT *, rail = min(rail) OVER (PARTITION BY product_id) AS fresh FROM cut),
counted AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY rail) AS n_fresh, row_number() OVER (PARTITION BY rail, fresh ORDER BY position) AS again FROM marked)
SELECT rail, position, product_id, fresh FROM counted WHERE fresh OR again <= 3 - n_fresh""")
def c18_home_sections(d: Domain):
    return rails.first_section(home(d))


@query(f""", {RAILS} SELECT a.rail AS "left", b.rail AS "right", count(*) AS common,
  round(count(*) / CAST(least((SELECT count(*) FROM cut c WHERE c.rail = a.rail), (SELECT count(*) FROM cut c WHERE c.rail = b.rail)) AS DOUBLE), 4) AS overlap
FROM cut a JOIN cut b ON a.product_id = b.product_id AND a.rail < b.rail GROUP BY a.rail, b.rail""")
def u5_rail_overlap(d: Domain):
    return rails.overlap(home(d))


@query(f""", {DAILY}, {DROPS}, facets AS (SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM products WHERE category = 'laptop' GROUP BY brand
  UNION ALL SELECT 'size', CAST(size AS VARCHAR), count(*) FROM products WHERE category = 'laptop' GROUP BY size
  UNION ALL SELECT 'color', color, count(*) FROM products WHERE category = 'laptop' GROUP BY color)
SELECT facet, value, n, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn FROM facets) WHERE rn <= 8""")
def c19_landing_facets(d: Domain):
    from pricelore.operators.catalog import facets, top_facets

    return top_facets(facets(d.products.where("category = 'laptop'"), ["brand", "size", "color"]), 8)


@query("""SELECT user_id AS run_id, page_no, n_ids, n_new, n_ids - n_new AS n_again, CASE WHEN n_ids = 0 THEN 'empty_page' WHEN rep THEN 'repeated_page' WHEN wo >= 3 THEN 'consecutive_no_new' WHEN page_no >= 40 THEN 'emergency_ceiling' END AS stop FROM (
SELECT *, sum(CASE WHEN n_new = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY page_no) AS wo FROM (
SELECT *, sum(CASE WHEN n_new > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY page_no) AS island, n_ids > 0 AND coalesce(lag(ids) OVER (PARTITION BY user_id ORDER BY page_no) = ids, false) AS rep FROM (
SELECT user_id, page_no, count(DISTINCT native_id) AS n_ids, count(DISTINCT CASE WHEN page_no = first_page THEN native_id END) AS n_new, list_sort(list(DISTINCT native_id)) AS ids FROM (
SELECT *, min(page_no) OVER (PARTITION BY user_id, native_id) AS first_page FROM (SELECT user_id, CAST(extract('day' FROM ts) AS BIGINT) AS page_no, CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 AS native_id FROM events))
GROUP BY user_id, page_no)))""")
def w12_saturation(d: Domain):
    pages = d.activity.withColumn("native_id", F.col("product_id") % 9)
    e = d.table("events").select("event_id", "user_id")
    pages = pages.join(e, "event_id").select(F.col("user_id").alias("run_id"), F.dayofmonth("ts").cast("long").alias("page_no"), "native_id")
    return rails.saturation(pages)
