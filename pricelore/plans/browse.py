"""Queries of ordered pages, cursors, comparison rows, card signals and small audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.functions import specs
from pricelore.operators import browse as op
from pricelore.operators import matching as identity
from pricelore.plans import matching
from pricelore.plans.base import Registry
from pricelore.sources.views import CATEGORIES, COLORS, Domain, nth, sql_nth

registry = Registry()
query = registry.query

MODES = ("price_asc", "price_desc", "recently_checked", "relevance")
GROUPS = ("exact_match", "similar_variant", "related")
ITEMS_SQL = f""", seen AS (SELECT product_id, min(price) AS best_price, count(DISTINCT platform) AS platform_count, max(last_seen) AS last_seen_at FROM listings WHERE stock = 'in_stock' GROUP BY product_id),
items AS (SELECT p.product_id, category, status, size AS rank_score, {sql_nth(GROUPS, "p.product_id")} AS match_group, best_price, coalesce(platform_count, 0) AS platform_count, last_seen_at FROM products p LEFT JOIN seen s ON s.product_id = p.product_id)"""
#: Categories in the order in which single-store products are looked at.
PRIORITY = ("smartphone", "television", "tws", "headphones", "refrigerator", "washing_machine", "laptop", "camera")


def items(d: Domain) -> DataFrame:
    """product_id, category, status, rank_score, match_group, best_price, platform_count, last_seen_at."""
    seen = d.listings.where("stock = 'in_stock'").groupBy("product_id").agg(F.min("price").alias("best_price"), F.count_distinct("platform").alias("platform_count"), F.max("last_seen").alias("last_seen_at"))
    rows = d.products.join(seen, "product_id", "left")
    return rows.select("product_id", "category", "status", F.col("size").alias("rank_score"), nth(GROUPS, F.col("product_id")).alias("match_group"), "best_price", F.coalesce("platform_count", F.lit(0)).alias("platform_count"), "last_seen_at")


SEARCH_SQL = {
    "price_asc": "best_price ASC NULLS LAST, rank_score DESC, platform_count DESC, last_seen_at DESC NULLS LAST, product_id",
    "price_desc": "best_price DESC NULLS LAST, rank_score DESC, platform_count DESC, last_seen_at DESC NULLS LAST, product_id",
    "recently_checked": "last_seen_at DESC NULLS LAST, platform_count DESC, best_price ASC NULLS LAST, product_id",
    "relevance": "CASE match_group WHEN 'exact_match' THEN 3 WHEN 'similar_variant' THEN 2 ELSE 1 END DESC, rank_score DESC, platform_count DESC, last_seen_at DESC NULLS LAST, product_id",
}


@query(f"{ITEMS_SQL} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, position, product_id FROM (SELECT product_id, CAST(row_number() OVER (ORDER BY {SEARCH_SQL[m]}) AS INTEGER) AS position FROM items) WHERE position > 10 AND position <= 60" for m in MODES))
def t1_search_order(d: Domain):
    """The second page of each order of the search results."""
    rows = items(d)
    pages = [op.page(rows, op.search_order(m), 50, 10).select(F.lit(m).alias("mode"), "position", "product_id") for m in MODES]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


RANK_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(PRIORITY)) + " ELSE 8 END"


@query(f"{ITEMS_SQL} SELECT position, product_id, category FROM (SELECT *, CAST(row_number() OVER (ORDER BY {RANK_SQL}, best_price DESC NULLS LAST, product_id) AS INTEGER) AS position FROM items) WHERE position <= 200")
def t3_category_order(d: Domain):
    rank = F.coalesce(F.create_map(*(F.lit(x) for i, c in enumerate(PRIORITY) for x in (c, i)))[F.col("category")], F.lit(8))
    return op.page(items(d), [rank, F.col("best_price").desc_nulls_last(), F.asc("product_id")], 200).select("position", "product_id", "category")


BUCKETS = ("best_price ASC NULLS LAST, product_id", "platform_count DESC, product_id", "last_seen_at DESC NULLS LAST, product_id")


@query(f"{ITEMS_SQL}, given AS (" + " UNION ALL ".join(f"SELECT product_id, {i} AS bucket, row_number() OVER (ORDER BY {o}) AS place FROM items" for i, o in enumerate(BUCKETS)) + """),
first_of AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY bucket, place) AS rn FROM given WHERE place <= 20)
SELECT position, product_id, bucket FROM (SELECT *, CAST(row_number() OVER (ORDER BY bucket, place, product_id) AS INTEGER) AS position FROM first_of WHERE rn = 1) WHERE position <= 45""")
def u3_merged_buckets(d: Domain):
    rows = items(d)
    orders = ([F.col("best_price").asc_nulls_last()], [F.desc("platform_count")], [F.col("last_seen_at").desc_nulls_last()])
    return op.merged([op.page(rows, [*o, F.asc("product_id")], 20) for o in orders], "product_id", 45).select("position", "product_id", "bucket")


@query(f"{ITEMS_SQL} SELECT product_id, '/product/' || category || '/' || product_id AS path, last_seen_at FROM items WHERE status = 'active' AND best_price IS NOT NULL ORDER BY product_id LIMIT 100 OFFSET 50")
def s12_sitemap_page(d: Domain):
    rows = items(d).where("status = 'active' AND best_price IS NOT NULL")
    return op.page(rows, [F.asc("product_id")], 100, 50).select("product_id", F.concat(F.lit("/product/"), "category", F.lit("/"), F.col("product_id").cast("string")).alias("path"), "last_seen_at")


@query("""SELECT product_id, rtrim(translate(to_base64(encode('{"offset":' || o || '}')), '+/', '-_'), '=') AS cursor, CASE WHEN o BETWEEN 0 AND 5000 THEN o END AS decoded FROM (SELECT product_id, product_id * 37 % 6000 AS o FROM products)""")
def s13_cursors(d: Domain):
    text = op.cursor(F.col("product_id") * 37 % 6000)
    return d.products.select("product_id", text.alias("cursor"), op.offset_of(text).alias("decoded"))


WINDOWS = ("30d", " 90D", "6m", "1y", "all", "45d", "9999d", "0d", "soon")


@query(f"""SELECT product_id, CASE WHEN w IN ('30d', '90d', '180d', '6m', '1y', 'all') THEN CASE w WHEN '30d' THEN 30 WHEN '90d' THEN 90 WHEN '1y' THEN 365 WHEN 'all' THEN 3650 ELSE 180 END
  WHEN regexp_matches(w, '^[0-9]{{1,9}}d$') THEN greatest(1, least(CAST(regexp_extract(w, '^([0-9]+)d$', 1) AS BIGINT), 3650)) WHEN size IS NOT NULL THEN greatest(1, least(size, 3650)) ELSE 90 END AS days
FROM (SELECT product_id, lower(trim({sql_nth(WINDOWS, "product_id")})) AS w, CASE WHEN product_id % 2 = 0 THEN size END AS size FROM products)""")
def d3_history_windows(d: Domain):
    return d.products.select("product_id", op.history_days(nth(WINDOWS, F.col("product_id")), F.when(F.col("product_id") % 2 == 0, F.col("size"))).alias("days"))


@query(f"""SELECT day, {sql_nth(CATEGORIES, "(date_diff('day', DATE '0001-01-01', day) + 1) % 8")} AS spotlight FROM (SELECT DISTINCT day FROM observations)""")
def d5_day_spotlight(d: Domain):
    days = d.observations.select("day").distinct()
    return days.select("day", nth(CATEGORIES, op.rotation(F.col("day"), F.lit(len(CATEGORIES)))).alias("spotlight"))


@query(r"""SELECT listing_id, CASE WHEN v BETWEEN 100 AND 2000000 AND upper(trim(t)) NOT IN ('N/A', 'NA', 'NONE', 'NULL', 'COMPARE') THEN v END AS price FROM (
SELECT listing_id, t, TRY_CAST(nullif(regexp_replace(regexp_replace(trim(CASE WHEN m <> '' THEN m ELSE t END), '\.[0-9]{1,2}$', ''), '[^0-9]', '', 'g'), '') AS BIGINT) AS v FROM (
SELECT listing_id, t, regexp_extract(lower(t), '((?:₹|rs\.?|inr)\s?[0-9,]+(?:\.[0-9]+)?)', 1) AS m FROM (
SELECT listing_id, CASE listing_id % 5 WHEN 0 THEN 'MRP ' || (price * 2) || ' now ₹ ' || (price // 1000) || ',' || lpad(CAST(price % 1000 AS VARCHAR), 3, '0') || '.00' WHEN 1 THEN 'Rs.' || price WHEN 2 THEN 'N/A' WHEN 3 THEN ' ' || price || '.5 ' ELSE 'call for price' END AS t FROM listings)))""")
def f6_clean_price(d: Domain):
    p = F.col("price")
    grouped = F.concat(F.call_function("div", p, F.lit(1000)).cast("string"), F.lit(","), F.lpad((p % 1000).cast("string"), 3, "0"))
    text = (
        F.when(F.col("listing_id") % 5 == 0, F.concat(F.lit("MRP "), (p * 2).cast("string"), F.lit(" now ₹ "), grouped, F.lit(".00"))).when(F.col("listing_id") % 5 == 1, F.concat(F.lit("Rs."), p.cast("string")))
        .when(F.col("listing_id") % 5 == 2, "N/A").when(F.col("listing_id") % 5 == 3, F.concat(F.lit(" "), p.cast("string"), F.lit(".5 "))).otherwise("call for price")
    )
    return d.listings.select("listing_id", op.clean_price(text).alias("price"))


@query(rf"""SELECT doc_id, nullif(regexp_replace(regexp_extract(lower(text), '{op.COLORS}', 1), '\s+', ' ', 'g'), '') AS color FROM documents""")
def f26_colors(d: Domain):
    return d.table("documents").select("doc_id", op.color_of(F.col("text")).alias("color"))


COMPARED = ("ram_gb", "storage_gb", "screen_inch", "cpu", "gpu", "family")


@query(f"""{matching.TITLES_SQL}, long AS (""" + " UNION ALL ".join(f"SELECT title_id // 9 AS set_id, '{k}' AS key, lower(CAST({k} AS VARCHAR)) AS value FROM specs" for k in COMPARED) + """)
SELECT set_id, key, count(*) AS n, count(value) AS n_present, count(DISTINCT value) AS n_values, count(DISTINCT value) > 1 OR count(value) < count(*) AS differs FROM long GROUP BY set_id, key HAVING count(value) > 0""")
def c51_compare_rows(d: Domain):
    rows = identity.with_specs(matching.titles(d)).withColumn("set_id", F.call_function("div", F.col("title_id"), F.lit(9)))
    return op.compared(rows, "set_id", COMPARED)


@query(f"""{ITEMS_SQL}, daily AS (SELECT product_id, day, min(min_price) AS price FROM platform_days GROUP BY product_id, day),
last_two AS (SELECT product_id, last(price ORDER BY day) AS price, first(before ORDER BY day DESC) AS before, min(price) AS low FROM (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY day) AS before FROM daily) GROUP BY product_id)
SELECT i.product_id, CASE WHEN before - price >= 10000 THEN 'drop' WHEN price * 100 <= low * 103 THEN 'low' WHEN platform_count >= 3 THEN 'stores'
  WHEN date_diff('second', last_seen_at, TIMESTAMP '2001-11-05') <= 86400 THEN 'freshness' WHEN platform_count = 2 THEN 'stores' END AS kind FROM items i LEFT JOIN last_two l ON l.product_id = i.product_id""")
def c52_card_signals(d: Domain):
    daily = d.platform_days.groupBy("product_id", "day").agg(F.min("min_price").alias("price"))
    from pyspark.sql import Window

    moves = daily.withColumn("before", F.lag("price").over(Window.partitionBy("product_id").orderBy("day")))
    last = moves.groupBy("product_id").agg(F.max_by("price", "day").alias("price"), F.max_by("before", "day").alias("before"), F.min("price").alias("low"))
    rows = items(d).join(last, "product_id", "left")
    hours = F.expr("timestampdiff(SECOND, last_seen_at, TIMESTAMP_NTZ '2001-11-05 00:00:00')") / 3600
    rows = rows.select("product_id", (F.col("before") - F.col("price")).alias("dropped"), (F.col("price") * 100 <= F.col("low") * 103).alias("near_low"), F.col("platform_count").alias("stores"), hours.alias("hours"))
    return op.card_signals(rows).select("product_id", "kind")


@query("""SELECT p.product_id, p.expected_stores, coalesce(active_tasks, 0) AS active_tasks, oldest_seconds, CASE WHEN running THEN 'running' WHEN active_tasks > 0 THEN 'queued' ELSE 'idle' END AS status
FROM (SELECT product_id, count(*) AS expected_stores FROM listings WHERE match_status = 'matched' GROUP BY product_id) p LEFT JOIN (
  SELECT product_id, count(*) AS active_tasks, max(date_diff('second', created_at, TIMESTAMP '2001-11-05')) AS oldest_seconds, bool_or(status = 'running') AS running FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY created_at, task_id) AS rn FROM (SELECT task_id % 500 AS product_id, task_id, status, created_at FROM tasks WHERE status IN ('pending', 'running', 'queued', 'paused'))) WHERE rn <= 20 GROUP BY product_id) t
  ON t.product_id = p.product_id""")
def q17_verification(d: Domain):
    expected = d.listings.where("match_status = 'matched'").groupBy("product_id").agg(F.count("*").alias("expected_stores"))
    tasks = d.tasks.select((F.col("task_id") % 500).alias("product_id"), "task_id", "status", "created_at")
    return op.verification(expected, tasks, "2001-11-05 00:00:00")


@query("SELECT category, count(*) AS orphan_docs FROM products p WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.product_id = p.product_id AND l.match_status = 'matched' AND stock = 'in_stock') GROUP BY category")
def r2_orphans_by_category(d: Domain):
    """Products without a matched listing in stock."""
    there = d.listings.where("match_status = 'matched' AND stock = 'in_stock'").select("product_id")
    return d.products.join(there, "product_id", "left_anti").groupBy("category").agg(F.count("*").alias("orphan_docs"))


@query(f"""{matching.TITLES_SQL} SELECT brand, array_to_string(model_codes, ',') AS model_codes, count(*) AS n, min(title_id) AS first_id, max(title_id) AS last_id FROM specs WHERE len(model_codes) > 0 GROUP BY brand, model_codes HAVING count(*) > 1""")
def r5_code_duplicates(d: Domain):
    rows = matching.titles(d).select("title_id", specs.brand(F.col("title")).alias("brand"), F.array_join(specs.model_codes(F.col("title")), ",").alias("model_codes")).where("model_codes <> ''")
    return rows.groupBy("brand", "model_codes").agg(F.count("*").alias("n"), F.min("title_id").alias("first_id"), F.max("title_id").alias("last_id")).where("n > 1")


@query(f"""SELECT product_id, array_to_string(list_transform(from_json(j, '["VARCHAR"]'), lambda x: upper(x)), ' ') AS codes FROM (
SELECT product_id, CASE WHEN product_id % 3 = 0 THEN '[]' ELSE '["' || {sql_nth(COLORS, "product_id")} || '-' || product_id || '","x' || size || '"]' END AS j FROM products)""")
def a9_joined_codes(d: Domain):
    given = F.concat(F.lit('["'), nth(COLORS, F.col("product_id")), F.lit("-"), F.col("product_id").cast("string"), F.lit('","x'), F.col("size").cast("string"), F.lit('"]'))
    text = F.when(F.col("product_id") % 3 == 0, "[]").otherwise(given)
    return d.products.select("product_id", F.array_join(F.transform(F.from_json(text, "array<string>"), F.upper), " ").alias("codes"))
