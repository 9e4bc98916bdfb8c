"""Queries of offers' texts, listings' completeness, matching scores, merges, coverage and JSON records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pricelore.functions import offers as fn
from pricelore.functions import specs
from pricelore.operators import listings as op
from pricelore.operators import matching, merging
from pricelore.plans.base import Registry
from pricelore.plans.catalog import SEARCH
from pricelore.plans.catalog import found as ranked_search
from pricelore.plans.matching import IDENTITIES_SQL, PAIRS_SQL, TITLES_SQL, titles
from pricelore.plans.text import ladder
from pricelore.sources import records
from pricelore.sources.views import AS_OF, CATEGORIES, PLATFORMS, Domain, nth, sql_nth
from pricelore.streaming.activity import kept, scratch

registry = Registry()
query = registry.query

HEADS = (
    "Samsung Galaxy S24 5G", "Canon EOS R50 mirrorless camera body", "Sony WH-1000XM5 headphones", "Apple iPhone 15 128 GB", "Tempered glass for Redmi Note",
    "50 MP camera, 5000 mAh battery, AMOLED", "LG front load washing machine", "Refrigerator stand", "TV wall mount", "Charging case for buds",
    "Nikon camera bag", "8 GB RAM and more", "Tempered Display & cover, black", "Samsung", "RF-S 18-45 zoom lens", "OnePlus Nord 8 GB", "Galaxy Tab 64 GB", "Sony Alpha kit with 18 - 55 mm",
)
TAILS = (
    "", "online at best price on Flipkart.com", "Best Seller no cost EMI", "- Buy Online | Free Delivery", "(buy online) black", "20% off today", "Rs 12,999.00 only", "₹1,29,999 | EMI from ₹999",
    "EMI ₹499 per month", "&#8377;45,990; bank offer", "inclusive of all taxes", "with Alexa", "499", "12, 13, 14, 15", "save ₹ 500 with offers", "amazon.in", "deal of the day price 2999\nexchange", "N/A",
)
TEXTS = f", texts AS (SELECT product_id, category, {sql_nth(HEADS, 'product_id')} || ' ' || {sql_nth(TAILS, 'product_id // 18')} AS text FROM products)"


def texts(d: Domain) -> DataFrame:
    """product_id, category, text: each product's category with a shop's title."""
    n = F.col("product_id")
    return d.products.select("product_id", "category", F.concat_ws(" ", nth(HEADS, n), nth(TAILS, F.call_function("div", n, F.lit(18)))).alias("text"))


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def nested(text: str, pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    return text


@query(f"""{TEXTS}, plain AS (SELECT product_id, {nested("lower(text)", fn.ENTITIES)} AS t FROM texts),
parts AS (SELECT *, regexp_split_to_array(t, '[\\n|;]+')[1] AS a FROM plain),
raw AS (SELECT *, CASE WHEN regexp_extract(a, {lit(fn.PRICE)}, 1) <> '' THEN regexp_extract(a, {lit(fn.PRICE)}, 1) WHEN NOT {like("t", fn.PRICE_NOISE)} THEN
  CASE WHEN regexp_extract(t, {lit(fn.PRICE)}, 1) <> '' THEN regexp_extract(t, {lit(fn.PRICE)}, 1) ELSE regexp_replace(t, '[^0-9]', '', 'g') END END AS r FROM parts),
digits AS (SELECT *, regexp_replace(regexp_replace(r, '\\.[0-9]{{1,2}}$', ''), '[^0-9]', '', 'g') AS n FROM raw)
SELECT product_id, CASE WHEN NOT {like("a", fn.PRICE_NOISE)} AND length(n) BETWEEN 1 AND 18 AND TRY_CAST(n AS BIGINT) BETWEEN 100 AND 2000000 THEN TRY_CAST(n AS BIGINT) END AS price FROM digits""")
def f7_price_in_text(d: Domain):
    return texts(d).select("product_id", fn.price_in_text(F.col("text")).alias("price"))


CODES = (("QA55LS03HEUL", "x"), ("55Q7F", "QN90F"), ("ua43", "99ABC1"), ("65QN90F", "QN65QN90FAU"), ("", "-"))
CODES_SQL = f", coded AS (SELECT product_id, [c || CASE WHEN product_id % 3 = 0 THEN '' ELSE CAST(product_id % 7 AS VARCHAR) END for c in string_split({sql_nth(tuple(' '.join(c) for c in CODES), 'product_id')}, ' ')] AS codes FROM products)"


@query(f"""{CODES_SQL}, clean AS (SELECT product_id, list_filter(list_transform(codes, lambda c: regexp_replace(upper(c), '[^A-Z0-9]', '', 'g')), lambda c: c <> '') AS codes FROM coded),
aliased AS (SELECT product_id, list_filter(flatten(list_transform(codes, lambda c: [c, CASE WHEN length(regexp_extract(c, {lit(fn.TV_SERIES)}, 1)) >= 4 THEN regexp_extract(c, {lit(fn.TV_SERIES)}, 1) END,
  CASE WHEN TRY_CAST(regexp_extract(c, {lit(fn.TV_SIZE)}, 1) AS INTEGER) BETWEEN 24 AND 98 AND length(regexp_extract(c, {lit(fn.TV_SIZE)}, 2)) >= 3 THEN regexp_extract(c, {lit(fn.TV_SIZE)}, 2) END])), lambda c: c IS NOT NULL) AS a FROM clean),
pools AS (SELECT *, CASE WHEN len(list_filter(a, lambda c: NOT regexp_matches(c, '{fn.TV_BARE}'))) > 0 THEN list_filter(a, lambda c: NOT regexp_matches(c, '{fn.TV_BARE}')) ELSE a END AS pool FROM aliased)
SELECT product_id, array_to_string(list_sort(list_distinct(a)), ',') AS aliases, substr(list_min(list_transform(pool, lambda c: lpad(CAST(length(c) AS VARCHAR), 4, '0') || c)), 5) AS tv_key FROM pools""")
def f18_tv_models(d: Domain):
    tail = F.when(F.col("product_id") % 3 == 0, "").otherwise((F.col("product_id") % 7).cast("string"))
    codes = F.transform(F.split(nth(tuple(" ".join(c) for c in CODES), F.col("product_id")), " "), lambda c: F.concat(c, tail))
    return d.products.select("product_id", F.array_join(F.array_sort(fn.tv_aliases(codes)), ",").alias("aliases"), fn.tv_key(codes).alias("tv_key"))


def type_sql(t: str, c: str) -> str:
    camera = f"({c} = 'camera' OR ({c} IN ('', 'unknown', 'accessory') AND {like(t, fn.CAMERA_CUE)}))"
    return f"""CASE WHEN {like(t, fn.APPLIANCE_ACCESSORY)} THEN 'appliance_accessory' WHEN {c} IN ('tws', 'headphones') AND {like(t, fn.AUDIO_ACCESSORY)} THEN 'audio_accessory'
  WHEN {c} = 'television' AND {like(t, fn.TV_ACCESSORY)} THEN 'tv_accessory' WHEN {c} = 'smartphone' AND {like(t, fn.PHONE_ACCESSORY)} THEN 'phone_accessory'
  WHEN {camera} AND {like(t, fn.CAMERA_ACCESSORY)} AND NOT {like(t, fn.CAMERA_NAMED)} THEN 'camera_accessory' WHEN {camera} AND {like(t, fn.CAMERA_LENS)} AND NOT {like(t, fn.CAMERA_WHOLE)} THEN 'camera_lens'
  WHEN {camera} AND {like(t, fn.CAMERA_KIT)} THEN 'camera_kit' WHEN {camera} AND {like(t, fn.CAMERA_BODY)} THEN 'camera_body' WHEN {c} = 'accessory' THEN 'accessory' ELSE 'product' END"""


KINDS = (*CATEGORIES, "camera", "accessory", "unknown")
PAIRS = ", ".join(f"'{p}'" for p in fn.COMPATIBLE)


@query(f"""{TEXTS}, typed AS (SELECT product_id, {type_sql("lower(text)", sql_nth(KINDS, "product_id"))} AS kind, {type_sql("lower(text)", "'camera'")} AS other FROM texts)
SELECT product_id, kind, other, kind = other OR kind || ' ' || other IN ({PAIRS}) OR other || ' ' || kind IN ({PAIRS}) AS compatible FROM typed""")
def f19_product_types(d: Domain):
    kinds = texts(d).select("product_id", fn.product_type(F.col("text"), nth(KINDS, F.col("product_id"))).alias("kind"), fn.product_type(F.col("text"), F.lit("camera")).alias("other"))
    return kinds.withColumn("compatible", fn.types_compatible(F.col("kind"), F.col("other")))


def feature_list_sql(x: str) -> str:
    low, commas = f"lower({x})", f"(length({x}) - length(replace({x}, ',', '')))"
    words = f"regexp_extract_all({low}, '([a-z0-9]+)')"
    markers = " + ".join(f"CAST(contains({low}, '{m}') AS INTEGER)" for m in fn.BULLETS)
    brands = ", ".join(f"'{b}'" for b in fn.TITLE_BRANDS)
    return f"""(length({x}) < 8 OR (len({words}) <= 2 AND len(list_filter({words}, lambda w: w NOT IN ({brands}))) = 0) OR ({commas} >= 3 AND {like(x, fn.FEATURES)}) OR {commas} >= 4
  OR {like(low, fn.FEATURE_FIRST)} OR {markers} >= 2 OR ({commas} >= 1 AND NOT {like(low, fn.KNOWN_BRAND)} AND ({commas} >= 2 OR contains({x}, '&'))))"""


@query(rf"""{TEXTS}, one AS (SELECT product_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM texts),
clean AS (SELECT *, nullif(regexp_replace(regexp_replace(regexp_replace(x, {lit(fn.SHOP_INLINE)}, ' ', 'g'), {lit(fn.SHOP_TAIL)}, '', 'g'), '^[\s|\-–—:]+|[\s|\-–—:]+$', '', 'g'), '') AS y FROM one)
SELECT product_id, {feature_list_sql("x")} AS feature_list, y AS clean_title, CASE WHEN NOT {feature_list_sql("y")} THEN y END AS public_title FROM clean""")
def f20_title_quality(d: Domain):
    t = F.col("text")
    return texts(d).select("product_id", fn.is_feature_list(t).alias("feature_list"), fn.without_shop_words(t).alias("clean_title"), fn.public_title(t).alias("public_title"))


@query(rf"{TEXTS} SELECT product_id, trim(regexp_replace(regexp_replace(trim(text), {lit(fn.PROMOTION)}, ' ', 'g'), '\s+', ' ', 'g')) AS title FROM texts")
def f22_without_promotions(d: Domain):
    return texts(d).select("product_id", fn.without_promotions(F.col("text")).alias("title"))


@query(f"""{TEXTS}, t AS (SELECT product_id, trim(lower(text)) AS t FROM texts)
SELECT product_id, CASE WHEN t = '' OR {like("t", fn.FRAGMENT)} THEN 'fragment' WHEN {like("t", fn.NOT_PHONE)} THEN 'wrong_category'
  WHEN ({like("t", fn.PHONE_BRAND)} AND {like("t", fn.PHONE_SHAPE)}) OR {like("t", fn.PHONE_NAMED)} THEN 'correct_smartphone' ELSE 'ambiguous' END AS verdict FROM t""")
def f23_phone_verdicts(d: Domain):
    return texts(d).select("product_id", fn.phone_verdict(F.col("text")).alias("verdict"))


PICTURES = (
    "https://rukminim2.FLIXCART.com/image/416/416/xif0q/a.jpeg?q=70&id=7", "//m.media-amazon.com/images/I/71x._AC_UL320_.jpg?th=1", "https://www.reliancedigital.in/medias/a.jpg?w=300&context=b&auto=webp",
    "data:image/png;base64,AA", "https://x.in/logo.png", "ftp://x.in/a.jpg", "https://cdn.x.in/a/b.jpg?v=1#top", " http://images.flipkart.com/128/a.jpg ",
)


def without_sql(names) -> str:
    return f"array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({', '.join(repr(n) for n in names)})), '&')"


PICTURES_SQL = rf""", given AS (SELECT product_id, {sql_nth(PICTURES, "product_id")} AS url FROM products),
raw AS (SELECT *, CASE WHEN starts_with(trim(url), '//') THEN 'https:' || trim(url) ELSE trim(url) END AS r FROM given),
parts AS (SELECT *, lower(regexp_extract(r, {lit(fn.PICTURE)}, 1)) AS s, lower(regexp_extract(r, {lit(fn.PICTURE)}, 2)) AS h, regexp_extract(r, {lit(fn.PICTURE)}, 3) AS p, regexp_extract(r, {lit(fn.PICTURE)}, 4) AS q FROM raw),
kinds AS (SELECT *, regexp_matches(h, 'flixcart\.com|flipkart') AS a, contains(h, 'amazon') AS b, regexp_matches(h, 'reliancedigital|jiomart') AS c FROM parts),
clean AS (SELECT *, CASE WHEN a THEN {without_sql(fn.SIZES_A)} WHEN b THEN '' WHEN c THEN {without_sql(fn.SIZES_B)} ELSE q END AS left_q,
  CASE WHEN a THEN regexp_replace(p, '{fn.THUMBS}', '/', 'g') WHEN b THEN regexp_replace(p, '{fn.SIZE_SUFFIX}', '.', 'g') ELSE p END AS left_p FROM kinds),
named AS (SELECT product_id, url, CASE WHEN s <> '' AND NOT contains(lower(r), 'javascript:') AND NOT regexp_matches(s || '://' || h || left_p || '?' || left_q, '{fn.BAD_PICTURE}')
  THEN s || '://' || h || left_p || CASE WHEN left_q <> '' THEN '?' || left_q ELSE '' END END AS picture FROM clean)"""


@query(f"{PICTURES_SQL} SELECT product_id, picture, sha256(coalesce(picture, trim(url))) AS picture_key FROM named")
def f27_pictures(d: Domain):
    url = nth(PICTURES, F.col("product_id"))
    return d.products.select("product_id", fn.picture_url(url).alias("picture"), fn.picture_key(url).alias("picture_key"))


@query(f"SELECT page_id, {ladder('lower(html)', fn.PAGE_RULES, 'selector_or_content_failure')} AS kind FROM pages")
def f28_empty_pages(d: Domain):
    return d.table("pages").select("page_id", fn.empty_page_kind(F.col("html")).alias("kind"))


KEY_SQL = f"""keyed AS (SELECT *, coalesce(lower(model_codes[1]), family) AS identity FROM specs)"""
NAME_SQL = "lower(title)"


@query(f"""{TITLES_SQL}, {KEY_SQL} SELECT title_id, CASE WHEN CAST(brand IS NOT NULL AS INTEGER) + CAST(identity IS NOT NULL AS INTEGER) + CAST(cpu IS NOT NULL AS INTEGER) + CAST(ram_gb IS NOT NULL AS INTEGER) + CAST(storage_gb IS NOT NULL AS INTEGER) >= 4
  THEN replace(concat_ws('|', 'laptop', brand, identity, trim(cpu), ram_gb || 'gb', storage_gb || 'gb', coalesce(gpu, 'integrated_or_unknown'), CAST(screen_inch AS VARCHAR)), ' ', '_') END AS variant_key FROM keyed""")
def f32_variant_keys(d: Domain):
    found = matching.with_specs(titles(d))
    return found.select("title_id", op.variant_key(F.col("title")).alias("variant_key"))


@query(f"""{TITLES_SQL}, had AS (SELECT *, title_id % 3 AS n_images, title_id % 4 AS n_stores, CASE WHEN title_id % 5 > 0 THEN title_id END AS price,
  CAST(cpu IS NOT NULL AS INTEGER) + CAST(gpu IS NOT NULL AS INTEGER) + CAST(ram_gb IS NOT NULL AS INTEGER) + CAST(storage_gb IS NOT NULL AS INTEGER) + CAST(screen_inch IS NOT NULL AS INTEGER) AS known FROM specs)
SELECT title_id, len(model_codes) > 0 AS has_model_number, coalesce(ram_gb, storage_gb, screen_inch) IS NOT NULL AS has_variant_identity, n_images >= 1 AS has_primary_image, n_images >= 2 AS has_gallery,
  known >= 2 AS has_key_specs, price IS NOT NULL AS has_valid_price, n_stores >= 2 AS has_multi_store, NOT (n_images >= 2 AND len(model_codes) > 0 AND known >= 2) AS needs_enrichment FROM had""")
def f33_completeness(d: Domain):
    n = F.col("title_id")
    had = matching.with_specs(titles(d)).withColumns({"n_images": n % 3, "n_stores": n % 4, "price": F.when(n % 5 > 0, n)})
    kept = ("has_model_number", "has_variant_identity", "has_primary_image", "has_gallery", "has_key_specs", "has_valid_price", "has_multi_store", "needs_enrichment")
    return op.completeness(had).select("title_id", *kept)


def rank_sql(value: str, names) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + f" ELSE {len(names)} END"


@query(f""", stores AS (SELECT product_id, count(DISTINCT platform) AS n_stores FROM listings WHERE match_status = 'matched' GROUP BY product_id),
seen AS (SELECT l.*, CASE WHEN listing_id % 4 > 0 THEN last_seen END AS enriched_at, listing_id % 3 AS n_images FROM listings l)
SELECT listing_id, platform, category, n_images, n_stores FROM seen LEFT JOIN stores USING (product_id)
WHERE match_status = 'matched' AND platform IN ({", ".join(repr(p) for p in op.ENRICHED)}) AND (enriched_at IS NULL OR enriched_at < TIMESTAMP '{AS_OF}' - INTERVAL 72 HOURS)
  AND listing_id NOT IN (SELECT task_id * 10000 + task_id % 10 FROM tasks WHERE status IN ('pending', 'running'))
ORDER BY {rank_sql("category", op.CATEGORY_ORDER)}, n_images >= 2, coalesce(n_stores, 1) < 2, {rank_sql("platform", op.PLATFORM_ORDER)}, last_seen DESC, listing_id LIMIT 40""")
def q7_enrichment_due(d: Domain):
    n = F.col("listing_id")
    seen = d.listings.withColumns({"enriched_at": F.when(n % 4 > 0, F.col("last_seen")), "n_images": n % 3})
    open_tasks = d.tasks.where("status in ('pending', 'running')").select((F.col("task_id") * 10_000 + F.col("task_id") % 10).alias("listing_id"))
    return op.enrichment_due(seen, open_tasks, AS_OF).select("listing_id", "platform", "category", "n_images", "n_stores")


NUMBERS = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in op.SPECS)
DIFFER = ", ".join(f"CASE WHEN a.{c} <> b.{c} THEN '{c}' END" for c in op.SPECS)


@query(f"""{TITLES_SQL} SELECT a.title_id, {NUMBERS}, concat_ws(',', {DIFFER}) AS conflicts,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(a.model_codes, b.model_codes), lambda c: {specs.sql_normal_code("c")}), lambda c: c IS NOT NULL))), ',') AS model_codes
FROM specs a JOIN specs b ON b.title_id = a.title_id + 4 WHERE a.title_id % 3 = 1""")
def f34_merged_specs(d: Domain):
    """The second offer of each product takes in what the third one of the next product says."""
    found = matching.with_specs(titles(d))
    a = found.where("title_id % 3 = 1").select("title_id", F.struct("*").alias("a"))
    b = found.select((F.col("title_id") - 4).alias("title_id"), F.struct("*").alias("b"))
    return op.merged_specs(a.join(b, "title_id")).select("title_id", *op.SPECS, "conflicts", F.array_join("model_codes", ",").alias("model_codes"))


STATUSES = ("success", "partial", "failed", "unknown", "blocked", "not_found", "", "captcha")
WARNINGS = ("", "Timed out after 30 s", "DNS failed", "please sign-in", "selector missing", "no listings", "price odd")
ERRORS = ("TimeoutError", "ConnectionReset", "JSONDecodeError", "Login wall", "circuit open", "ValueError")
FAIL = f"""CASE WHEN s IN ('blocked', 'captcha') THEN 'challenge' WHEN s = 'not_found' THEN 'unavailable' WHEN {like("w", fn.LOGIN)} THEN 'login_required'
  WHEN s = 'failed' AND {like("w", fn.TIMEOUT)} THEN 'timeout' WHEN s IN ('failed', 'unknown') AND {like("w", fn.NETWORK)} THEN 'network'
  WHEN price IS NULL AND s IN ('success', 'partial', 'unknown', '') THEN CASE WHEN {like("w", fn.PARSE)} THEN 'parsing' WHEN {like("w", fn.EMPTY)} OR s IN ('', 'unknown') THEN 'empty' ELSE 'invalid_price' END
  WHEN e IS NOT NULL THEN CASE WHEN {like("e", fn.TIMEOUT)} THEN 'timeout' WHEN {like("e", fn.NETWORK)} THEN 'network' WHEN {like("e", fn.PARSE)} THEN 'parsing' WHEN {like("e", fn.LOGIN)} THEN 'login_required' WHEN contains(e, 'circuit') THEN 'blocked' ELSE 'unknown' END
  WHEN s = 'partial' THEN 'empty' ELSE 'unknown' END"""


@query(f""", runs AS (SELECT task_id, {sql_nth(STATUSES, "task_id")} AS s, lower({sql_nth(WARNINGS, "task_id // 8")}) AS w, CASE WHEN task_id % 3 = 0 THEN task_id END AS price, CASE WHEN task_id % 5 > 1 THEN lower({sql_nth(ERRORS, "task_id // 4")}) END AS e FROM tasks)
SELECT task_id, {FAIL} AS failure FROM runs""")
def f35_failures(d: Domain):
    n = F.col("task_id")
    div = lambda k: F.call_function("div", n, F.lit(k))
    failure = fn.failure_class(nth(STATUSES, n), nth(WARNINGS, div(8)), F.when(n % 3 == 0, n), F.when(n % 5 > 1, nth(ERRORS, div(4))))
    return d.tasks.select("task_id", failure.alias("failure"))


BOUNDS = "CASE category " + " ".join(f"WHEN '{c}' THEN price // 100 BETWEEN {a} AND {b}" for c, (a, b) in fn.PRICE_BOUNDS.items()) + f" ELSE price // 100 BETWEEN {fn.OTHER_BOUNDS[0]} AND {fn.OTHER_BOUNDS[1]} END"


@query(f"SELECT listing_id, {BOUNDS} AS within FROM listings")
def f38_price_bounds(d: Domain):
    return d.listings.select("listing_id", fn.in_bounds(F.call_function("div", F.col("price"), F.lit(100)), F.col("category")).alias("within"))


@query()
def c36_similarities(d: Domain):
    """Scores hang on matching blocks of letters: no SQL; tests hold them against a plain version."""
    found = op.code_relations(matching.identities(titles(d)))
    return found.select(F.col("a.title_id").alias("title_id"), F.col("b.title_id").alias("other_id"), F.round("jaccard", 6).alias("jaccard"), F.round("sequence", 6).alias("sequence"), "score", "weak")


@query()
def c37_assessments(d: Domain):
    found = op.code_relations(matching.identities(titles(d)))
    return found.select(F.col("a.title_id").alias("title_id"), F.col("b.title_id").alias("other_id"), "verdict", "points", "merge_allowed", "needs_review")


@query()
def c40_safe_merges(d: Domain):
    """Duplicates that may merge unseen, among identities that share a code, in greedy order. No SQL, as for c36."""
    found = matching.identities(titles(d)).withColumn("variant_key", op.variant_key(F.col("title")))
    return merging.greedy(merging.primary_first(op.safe_pairs(op.code_relations(found))), kept)


WORDS = ["laptop notebook macbook", "smartphone mobile phone iphone", "television tv smart tv", "refrigerator fridge", "washing_machine washing machine washer", "tws earbuds buds", "headphones headset", "camera dslr mirrorless"]


@query(f""", {SEARCH}, asked AS (SELECT unnest(range(1, {len(WORDS) + 1})) AS place, unnest({specs.sql_list(CATEGORIES)}) AS slug, unnest({specs.sql_list(WORDS)}) AS words),
named AS (SELECT row_number() OVER (ORDER BY place) AS position, slug FROM asked WHERE contains(words, 'smart phone') OR contains(words, 'smart') OR contains(words, 'phone'))
SELECT 'product' AS kind, rn AS position, CAST(product_id AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (ORDER BY score DESC, product_id) AS rn FROM ranked) WHERE rn <= 6
UNION ALL SELECT 'category', position, slug FROM named WHERE position <= 4""")
def c30_suggestions(d: Domain):
    categories = d.spark.createDataFrame(list(zip(range(1, len(WORDS) + 1), CATEGORIES, WORDS)), "place int, slug string, words string")
    return op.suggestions("Smart phone", ranked_search(d), categories)


@query(f"""{IDENTITIES_SQL}, had AS (SELECT title_id, category || '|' || brand || '|' || model_codes[1] || '|' || coalesce(CAST(ram_gb AS VARCHAR), '') AS identity_key, title_id % 4 AS n_stores, title_id % 9 AS n_listings FROM identities),
heads AS (SELECT identity_key, first(title_id ORDER BY n_stores DESC, n_listings DESC, title_id) AS head, count(*) AS n FROM had WHERE identity_key IS NOT NULL GROUP BY identity_key)
SELECT title_id, coalesce(head, title_id) AS head, coalesce(n, 1) AS n FROM had LEFT JOIN heads USING (identity_key)""")
def c42_same_identity(d: Domain):
    found = matching.with_specs(titles(d))
    code = F.get("model_codes", F.lit(0))
    key = F.when(F.col("brand").isNotNull() & code.isNotNull(), F.concat_ws("|", "category", "brand", code, F.coalesce(F.col("ram_gb").cast("string"), F.lit(""))))
    had = found.withColumns({"identity_key": key, "n_stores": F.col("title_id") % 4, "n_listings": F.col("title_id") % 9})
    return op.same_identity(had, "identity_key").select("title_id", "head", "n")


def merged_children(d: Domain) -> DataFrame:
    roots = d.products.select("product_id", (F.col("product_id") - F.col("product_id") % 6).alias("root"))
    return op.repointed(d.observations.select("observation_id", "product_id", "platform", "day", "price"), roots)


@query("SELECT product_id - product_id % 6 AS product_id, platform, day, min(price) AS min_price, count(*) AS n FROM observations GROUP BY ALL")
def c41_merged_days(d: Domain):
    """The daily rollup after every sixth product has taken in the five that follow."""
    return merged_children(d).groupBy("product_id", "platform", "day").agg(F.min("price").alias("min_price"), F.count("*").alias("n"))


@query("SELECT DISTINCT unnest([product_id, product_id - product_id % 6]) AS product_id, day FROM observations WHERE product_id % 6 <> 0")
def c41_dates_to_rebuild(d: Domain):
    return op.dates_to_rebuild(merged_children(d))


SUPPORTED = [(p, c) for p in PLATFORMS for c in CATEGORIES if not (p == "jiomart" and c in ("laptop", "camera")) and p != "bajajelectronics"]


@query(f""", supported AS (SELECT unnest([{", ".join(repr(p) for p, c in SUPPORTED)}]) AS platform, unnest([{", ".join(repr(c) for p, c in SUPPORTED)}]) AS category),
found AS (SELECT platform, category, count(*) AS discovered, count(*) FILTER (WHERE match_status = 'matched') AS accepted, avg(CASE WHEN price > 0 THEN 1.0 ELSE 0.0 END) AS priced, 1 - count(DISTINCT product_id) / CAST(count(*) AS DOUBLE) AS repeated FROM listings GROUP BY platform, category)
SELECT coalesce(f.platform, s.platform) AS platform, coalesce(f.category, s.category) AS category, coalesce(discovered, 0) AS discovered, coalesce(accepted, 0) AS accepted, round(priced, 3) AS price_rate, round(repeated, 3) AS duplicate_rate,
  CASE WHEN s.platform IS NULL THEN 'unsupported' WHEN discovered IS NULL THEN 'empty' WHEN discovered >= {op.USABLE} AND accepted >= {op.USABLE} AND priced >= {op.PRICED} AND repeated <= {op.REPEATED} THEN 'healthy' WHEN accepted >= 1 AND accepted < {op.USABLE} THEN 'partial' ELSE 'degraded' END AS status
FROM found f FULL JOIN supported s ON s.platform = f.platform AND s.category = f.category""")
def a19_coverage_health(d: Domain):
    return op.coverage_health(d.listings, d.spark.createDataFrame(SUPPORTED, "platform string, category string"))


@query(f"""{IDENTITIES_SQL} SELECT category, brand, family, count(*) AS n, array_to_string(list_sort(list(title_id)), ',') AS title_ids FROM (SELECT category, brand, family, min(title_id) AS title_id FROM identities WHERE family IS NOT NULL GROUP BY category, brand, family, exact_fingerprint) GROUP BY category, brand, family HAVING count(*) > 3""")
def r11_heavy_families(d: Domain):
    """Families with more than three identities, and a title of each."""
    found = matching.identities(titles(d)).where("family is not null").groupBy("category", "brand", "family", "exact_fingerprint").agg(F.min("title_id").alias("title_id"))
    by = found.groupBy("category", "brand", "family").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("title_id")).alias("t")).where("n > 3")
    return by.select("category", "brand", "family", "n", F.array_join("t", ",").alias("title_ids"))


@query(""", m AS (SELECT *, CAST(listing_id % 2 AS VARCHAR) AS native_id FROM listings WHERE match_status = 'matched'),
g AS (SELECT product_id, platform, first(listing_id ORDER BY stock <> 'in_stock', price, listing_id) AS primary_id, count(DISTINCT native_id) <= 1 AS exact_clone FROM m GROUP BY product_id, platform HAVING count(*) > 1)
SELECT listing_id, primary_id, CASE WHEN listing_id = primary_id THEN 'primary' ELSE 'alias' END AS role, exact_clone FROM m JOIN g USING (product_id, platform)""")
def r12_listing_roles(d: Domain):
    rows = d.listings.withColumn("native_id", (F.col("listing_id") % 2).cast("string"))
    return op.listing_roles(rows).select("listing_id", "primary_id", "role", "exact_clone")


@query("SELECT product_id, title, size, CAST(1 AS BIGINT) AS schema_version FROM products")
def s5_raw_records(d: Domain):
    """Products written as JSON with the form's version, and read back."""
    path = scratch(d.spark, "records")
    records.write_raw(d.products.select("product_id", "title", "size"), path)
    schema = StructType([StructField("product_id", LongType()), StructField("title", StringType()), StructField("size", LongType()), StructField("schema_version", LongType())])
    return records.read_records(d.spark, path, schema, multi_line=False)
