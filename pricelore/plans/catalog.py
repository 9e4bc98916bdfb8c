"""Queries of the catalogue and of search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelore.operators import catalog as op
from pricelore.operators import prices
from pricelore.plans.base import Registry
from pricelore.plans.rails import SHOWN
from pricelore.sources.views import Domain
from pricelore.streaming.activity import kept

registry = Registry()
query = registry.query

BEST = f"""{SHOWN}, best AS (SELECT p.product_id, p.category, brand, coalesce(min(CASE WHEN stock <> 'out_of_stock' THEN price END), min(price)) AS best_price,
  first(platform ORDER BY CASE WHEN stock <> 'out_of_stock' THEN 0 ELSE 1 END, price, platform) AS best_platform, count(DISTINCT platform) AS platform_count
  FROM products p JOIN shown s ON s.product_id = p.product_id WHERE status = 'active' GROUP BY p.product_id, p.category, brand)"""
GROUPS = """groups AS (SELECT *, count(*) OVER (PARTITION BY category, brand, lower(trim(title))) AS n FROM products WHERE status = 'active')"""
WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
TRI = "list_distinct(flatten(list_transform(" + WORDS + ", lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def grams(text: str) -> str:
    return TRI.format(text)


def best(d: Domain):
    rows = prices.best_price(d.products, d.listings).where("platform_count > 0")
    return rows.join(d.products.select("product_id", "brand"), "product_id")


@query(f""", {BEST}, titled AS (SELECT b.*, lower(trim(title)) AS t FROM best b JOIN products p ON p.product_id = b.product_id),
near AS (SELECT s.product_id AS seed, b.product_id, b.best_price, row_number() OVER (PARTITION BY s.product_id ORDER BY b.brand <> s.brand, abs(b.best_price - s.best_price), b.product_id) AS position
  FROM titled s JOIN titled b ON b.category = s.category AND b.product_id <> s.product_id AND b.best_price * 100 BETWEEN s.best_price * 55 AND s.best_price * 180
  WHERE s.best_price > 0 AND NOT (b.brand = s.brand AND b.t = s.t))
SELECT seed, product_id, best_price, position FROM near WHERE position <= 8""")
def c31_similar_products(d: Domain):
    rows = kept(best(d).select("product_id", "category", "brand", "best_price"), "best")
    return op.similar_products(rows, rows, groups=op.variant_groups(d.products), written=kept)


@query(f", {GROUPS} SELECT substr(sha256(concat_ws('|', category, brand, lower(trim(title)))), 1, 16) AS group_id, product_id, n FROM groups WHERE n > 1")
def c44_variant_groups(d: Domain):
    return op.variant_groups(d.products)


@query(f""", {GROUPS} SELECT substr(sha256(concat_ws('|', category, brand, lower(trim(title)))), 1, 16) AS group_id, product_id, min(product_id) OVER (PARTITION BY category, brand, lower(trim(title))) AS representative, n FROM groups WHERE n > 1""")
def j14_variant_peers(d: Domain):
    return op.variant_members(op.variant_groups(d.products))


@query(f""", {BEST}, wanted AS (SELECT * FROM (VALUES (3, 1), (11, 2), (17, 3), (4, 4)) v(product_id, position)),
rows AS (SELECT CAST(w.position AS BIGINT) AS position, CAST(w.product_id AS BIGINT) AS product_id, p.category, best_price, status FROM wanted w LEFT JOIN products p ON p.product_id = w.product_id LEFT JOIN best b ON b.product_id = w.product_id)
SELECT position, product_id, category, best_price, CASE WHEN status IS NULL OR status <> 'active' THEN 'missing'
  WHEN category <> (SELECT first(category ORDER BY position) FROM rows WHERE status = 'active') THEN 'skipped' ELSE 'compared' END AS state FROM rows""")
def c32_compare_set(d: Domain):
    return op.compare_set([3, 11, 17, 4, 19], best(d), d.products)


@query("""SELECT product_id, product_id - (product_id % 6) AS root, product_id % 6 AS depth, false AS looped FROM products""")
def j18_roots(d: Domain):
    """Every sixth product is a root; the others point to the one before."""
    pointers = d.products.select("product_id", F.when(F.col("product_id") % 6 != 0, F.col("product_id") - 1).alias("duplicate_of"))
    return op.resolve_roots(pointers, 6)


@query(f""", {BEST}, seen AS (SELECT product_id, count(*) AS n_listings, max(last_seen) AS last_seen FROM listings GROUP BY product_id),
docs AS (SELECT *, lower(concat_ws(' ', category, brand, title, CAST(size AS VARCHAR), color)) AS search_text FROM products WHERE status = 'active')
SELECT d.product_id, d.category, search_text, best_price, best_platform, platform_count, coalesce(n_listings, 0) AS n_listings, last_seen,
  array_to_string(list_sort(list_distinct({WORDS.format("search_text")})), ' ') AS tokens
FROM docs d LEFT JOIN best b ON b.product_id = d.product_id LEFT JOIN seen s ON s.product_id = d.product_id""")
def c33_search_documents(d: Domain):
    rows = op.search_documents(d.products, best(d), d.listings)
    return rows.select("product_id", "category", "search_text", "best_price", "best_platform", "platform_count", "n_listings", "last_seen", F.array_join("tokens", " ").alias("tokens"))


SEARCH = f"""{BEST}, docs AS (SELECT p.product_id, p.category, best_price, coalesce(platform_count, 0) AS platform_count, lower(concat_ws(' ', p.category, p.brand, title, CAST(size AS VARCHAR), color)) AS search_text
  FROM products p LEFT JOIN best b ON b.product_id = p.product_id WHERE status = 'active'),
terms AS (SELECT *, len(list_intersect(list_distinct({WORDS.format("search_text")}), ['laptop', 'red', 'widget'])) / CAST(3 AS DOUBLE) AS word_share, {grams("search_text")} AS g, {grams("'red widget laptop'")} AS gq FROM docs),
scored AS (SELECT *, len(list_intersect(g, gq)) / CAST(len(list_distinct(list_concat(g, gq))) AS DOUBLE) AS near FROM terms),
ranked AS (SELECT product_id, category, best_price, CASE WHEN word_share = 1 THEN 'exact' WHEN word_share >= 0.5 THEN 'variant' ELSE 'related' END AS match_group,
  round(40.0 * word_share + CASE WHEN contains(search_text, 'red widget laptop') THEN 25.0 ELSE 0.0 END + 20.0 * near + 10.0 * least(platform_count, 5) / 5 + CASE WHEN best_price IS NOT NULL THEN 5.0 ELSE 0.0 END, 4) AS score
  FROM scored WHERE word_share > 0 OR near >= 0.1)"""


def found(d: Domain):
    return op.search(op.search_documents(d.products, best(d), d.listings), "red widget laptop")


@query(f", {SEARCH} SELECT * FROM ranked")
def c25_ranked_search(d: Domain):
    return found(d)


@query(f", {SEARCH} SELECT product_id, category, match_group, score, rn AS turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, product_id) AS rn FROM ranked) WHERE rn <= 16")
def c26_cross_category_search(d: Domain):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "product_id"))
    return found(d).withColumn("turn", rn.cast("long")).where("turn <= 16").select("product_id", "category", "match_group", "score", "turn")


@query(f", {SEARCH} SELECT facet, value, n FROM (SELECT 'category' AS facet, category AS value, count(*) AS n FROM ranked GROUP BY category UNION ALL SELECT 'match_group', match_group, count(*) FROM ranked GROUP BY match_group)")
def c29_search_facets(d: Domain):
    return op.facets(found(d), ["category", "match_group"])


TITLES = "titles AS (SELECT product_id AS id, category || '/' || brand AS block, title || ' ' || color || ' ' || CAST(size AS VARCHAR) AS text FROM products)"


def titles(d: Domain):
    text = F.concat_ws(" ", "title", "color", F.col("size").cast("string"))
    return d.products.select(F.col("product_id").alias("id"), F.concat_ws("/", "category", "brand").alias("block"), text.alias("text"))


@query(f""", {TITLES}, g AS (SELECT id, block, {grams("text")} AS grams FROM titles),
pairs AS (SELECT a.id AS "left", b.id AS "right", len(list_intersect(a.grams, b.grams)) / CAST(len(list_distinct(list_concat(a.grams, b.grams))) AS DOUBLE) AS s FROM g a JOIN g b ON a.block = b.block AND a.id < b.id)
SELECT "left", "right", round(s, 6) AS similarity FROM pairs WHERE s >= 0.6""")
def j12_similar_titles(d: Domain):
    return op.similar_titles(titles(d), 0.6)


POOLS = """exact AS (SELECT l.listing_id, p.product_id, 1.0 AS similarity, 'same' AS source, 0 AS r FROM listings l JOIN products p ON p.product_id = l.product_id),
brand AS (SELECT l.listing_id, q.product_id, 0.5, 'brand', 1 FROM listings l JOIN products p ON p.product_id = l.product_id JOIN products q ON q.category = p.category AND q.brand = p.brand),
pool AS (SELECT * FROM exact UNION ALL SELECT * FROM brand),
merged AS (SELECT listing_id, product_id, CAST(max(similarity) AS DOUBLE) AS similarity, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(r) AS "rank" FROM pool GROUP BY listing_id, product_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY "rank", similarity DESC, product_id) AS position FROM merged)"""


#: Candidates of a listing.
KEPT = 13


def pools(d: Domain):
    """Whatever the listing, the first products of its category and brand are its candidates, besides its own."""
    asked = d.listings.select("listing_id", "product_id").join(d.products.select("product_id", "category", "brand"), "product_id")
    return op.block_candidates(asked, d.products, ["category", "brand"], KEPT)


@query(f", {POOLS} SELECT * FROM placed WHERE position <= 13")
def c38_candidates(d: Domain):
    rows = pools(d).select("listing_id", F.explode("candidates").alias("c"))
    return rows.select("listing_id", "c.product_id", "c.similarity", F.array_join("c.sources", ",").alias("sources"), "c.rank", "c.position")


JUDGED = """judged AS (SELECT *, 60.0 + 40.0 * similarity - position AS score, similarity = 1 AND listing_id % 3 <> 0 AS may_merge FROM placed WHERE position <= 13),
firsts AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY may_merge DESC, CASE WHEN may_merge THEN position END NULLS LAST, score DESC, position) AS rn FROM judged)
SELECT listing_id, CASE WHEN may_merge OR score >= 70 THEN product_id END AS product_id, CAST(score AS DOUBLE) AS score, CASE WHEN may_merge THEN 'matched' WHEN score >= 70 THEN 'needs_review' ELSE 'unmatched' END AS state FROM firsts WHERE rn = 1"""


@query(f", {POOLS}, {JUDGED}")
def c39_choose_match(d: Domain):
    return matches(pools(d))


def matches(found):
    score = lambda c: c["similarity"] * 40.0 + 60.0 - c["position"]
    judged = lambda c: F.struct(c["position"].alias("position"), c["product_id"].alias("product_id"), score(c).alias("score"), ((c["similarity"] == 1) & (F.col("listing_id") % 3 != 0)).alias("may_merge"))
    return op.best_candidate(found.select("listing_id", F.transform("candidates", judged).alias("candidates")))
