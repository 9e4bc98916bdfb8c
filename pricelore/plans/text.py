"""Queries of text, URL, page and query functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelore.functions import text as fn
from pricelore.plans.base import Registry
from pricelore.sources.views import Domain

registry = Registry()
query = registry.query

ESCAPED = [x.replace("'", "''") for x in (fn.ACCENTS, fn.PLAIN)]
FOLDED = f"lower(regexp_replace(translate(text, '{ESCAPED[0]}', '{ESCAPED[1]}'), '{fn.NOT_ASCII}', '', 'g'))"
TITLE = f"trim(regexp_replace(regexp_replace(regexp_replace(replace({FOLDED}, '&', ' and '), '{fn.SYMBOLS}', ' ', 'g'), '{fn.NOISE}', ' ', 'g'), '{fn.SPACES}', ' ', 'g'))"
URL = r"""lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '')
|| CASE WHEN q <> '' THEN '?' || q ELSE '' END"""
PAGES = rf"""given AS (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT lower(regexp_extract(p, '^([^=]*)', 1)) IN ({", ".join(repr(t) for t in fn.TRACKING)}) AND NOT lower(p) LIKE 'utm\_%' ESCAPE '\'), '&') AS q FROM pages),
urls AS (SELECT *, {URL} AS normal, nullif(regexp_extract(url, '/([0-9]+)(?:[/?#].*)?$', 1), '') AS native FROM given)"""


def ladder(text: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{otherwise}' END"


@query(f"SELECT doc_id, sha1({TITLE}) AS title_sha, CAST(length({TITLE}) AS BIGINT) AS n FROM documents")
def f1_normalise_title(d: Domain):
    title = fn.normalise_title(F.col("text"))
    return d.table("documents").select("doc_id", F.sha1(title).alias("title_sha"), F.length(title).cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha1(array_to_string(t, ' ')) AS tokens_sha FROM (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({TITLE}, ' '), lambda x: length(x) >= 2))) AS t FROM documents)")
def f2_title_tokens(d: Domain):
    tokens = fn.title_tokens(F.col("text"))
    return d.table("documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.sha1(F.array_join(tokens, " ")).alias("tokens_sha"))


@query(r"""SELECT doc_id, CASE WHEN v BETWEEN 1 AND 10000000 THEN v END AS price, CASE WHEN p BETWEEN 1 AND 95 THEN p END AS discount FROM (
SELECT doc_id, CASE WHEN length(n) BETWEEN 1 AND 12 THEN CAST(n AS BIGINT) END AS v, CASE WHEN m <> '' THEN CAST(m AS INTEGER) END AS p FROM (
SELECT doc_id, replace(regexp_extract(text, '([0-9][0-9,]*)', 1), ',', '') AS n, regexp_extract(text, '([0-9]{1,3}) ?%', 1) AS m FROM documents))""")
def f4_parse_price(d: Domain):
    return d.table("documents").select("doc_id", fn.parse_price(F.col("text")).alias("price"), fn.parse_discount(F.col("text")).alias("discount"))


@query("""SELECT listing_id, CASE WHEN price > 0 AND mrp > 0 AND v > 0 AND v <= 95 THEN v END AS percent FROM (SELECT *, round(100.0 * (mrp - price) / mrp, 2) AS v FROM listings)""")
def f8_discount_percent(d: Domain):
    return d.listings.select("listing_id", fn.discount_percent(F.col("price"), F.col("mrp")).alias("percent"))


@query(f", {PAGES} SELECT page_id, normal AS url, native AS native_id FROM urls")
def f9_normalise_url(d: Domain):
    return d.table("pages").select("page_id", fn.normalise_url(F.col("url")).alias("url"), fn.native_id(F.col("url")).alias("native_id"))


@query(f", {PAGES} SELECT page_id, coalesce('web:' || native, 'web:u:' || substr(sha1(normal), 1, 16)) AS listing_key FROM urls")
def f11_listing_key(d: Domain):
    return d.table("pages").select("page_id", fn.listing_key(F.lit("web"), F.col("url"), F.lit("")).alias("listing_key"))


@query("SELECT observation_id, sha256(listing_id || '|' || strftime(observed_at, '%Y-%m-%d %H:%M:%S') || '|' || price || '|' || mrp) AS observation_hash FROM observations")
def f12_observation_hash(d: Domain):
    key = F.concat_ws("|", F.col("listing_id").cast("string"), F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss"), F.col("price").cast("string"), F.col("mrp").cast("string"))
    return d.observations.select("observation_id", F.sha2(key, 256).alias("observation_hash"))


@query(f"SELECT doc_id, {ladder(FOLDED, fn.CATEGORY_RULES, 'unknown')} AS category FROM documents")
def f14_category(d: Domain):
    return d.table("documents").select("doc_id", fn.category_of(F.col("text")).alias("category"))


@query(f"SELECT page_id, {ladder('lower(html)', fn.STOCK_RULES, 'unknown')} AS stock, regexp_matches(lower(html), '{fn.BLOCKED}') AS blocked FROM pages")
def f24_stock_text(d: Domain):
    return d.table("pages").select("page_id", fn.stock_of(F.col("html")).alias("stock"), fn.is_blocked(F.col("html")).alias("blocked"))


ASKED = "asked AS (SELECT search_id, query || CASE search_id % 4 WHEN 0 THEN ' under 70k' WHEN 1 THEN ' between 10000 and 2 lakh' WHEN 2 THEN ' above 500' ELSE '' END AS q FROM searches)"


def asked(d: Domain):
    tail = F.when(F.col("search_id") % 4 == 0, " under 70k").when(F.col("search_id") % 4 == 1, " between 10000 and 2 lakh").when(F.col("search_id") % 4 == 2, " above 500").otherwise("")
    return d.searches.select("search_id", F.concat("query", tail).alias("q"))


@query(f", {ASKED} SELECT search_id, CAST(CASE search_id % 4 WHEN 1 THEN 10000 WHEN 2 THEN 500 END AS BIGINT) AS low, CAST(CASE search_id % 4 WHEN 0 THEN 70000 WHEN 1 THEN 200000 END AS BIGINT) AS high FROM asked")
def f29_price_intent(d: Domain):
    return asked(d).select("search_id", fn.price_intent(F.col("q")).alias("i")).select("search_id", "i.low", "i.high")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
CAST((length(html) - length(replace(html, '<a href="', ''))) // 9 AS BIGINT) AS n_links, CAST(length(html) AS BIGINT) AS n_chars FROM pages""")
def s9_page_titles(d: Domain):
    html = F.col("html")
    links = F.floor((F.length(html) - F.length(F.replace(html, F.lit('<a href="'), F.lit("")))) / 9)
    return d.table("pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), links.alias("n_links"), F.length(html).cast("long").alias("n_chars"))
