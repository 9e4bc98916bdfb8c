"""Queries of specifications in JSON, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.operators import semistructured as op
from pricelore.plans.base import Registry
from pricelore.sources.views import Domain

registry = Registry()
query = registry.query

SPECS_SQL = """, spec AS (SELECT product_id, category, brand, CASE WHEN product_id % 11 = 0 THEN 'broken {' WHEN product_id % 11 = 1 THEN '[1, "two", null]' ELSE '{"size": ' || CASE WHEN product_id % 3 = 0 THEN '"' || size || '"' ELSE CAST(size AS VARCHAR) END
  || ', "color": "' || upper(color) || '", "oled": ' || CASE WHEN product_id % 4 = 0 THEN 'true' WHEN product_id % 4 = 1 THEN '"false"' ELSE 'null' END
  || CASE WHEN product_id % 5 < 3 THEN ', "model_codes": [' || CASE product_id % 5 WHEN 0 THEN '' WHEN 1 THEN '"A' || product_id || '"' ELSE '"B", "C"' END || ']' ELSE '' END || '}' END AS specs FROM products),
valid AS (SELECT *, json_valid(specs) AS ok, CASE WHEN json_valid(specs) THEN CAST(specs AS JSON) END AS j FROM spec)"""


def specs(d: Domain) -> DataFrame:
    """product_id, category, brand, specs: JSON with numbers as numbers or texts, nulls, lists of codes; each eleventh text is broken, or a list."""
    i, size = F.col("product_id"), F.col("size").cast("string")
    part = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    codes = F.when(i % 5 == 0, "").when(i % 5 == 1, part('"A', i.cast("string"), '"')).otherwise('"B", "C"')
    text = part(
        '{"size": ', F.when(i % 3 == 0, part('"', size, '"')).otherwise(size), ', "color": "', F.upper("color"), '", "oled": ', F.when(i % 4 == 0, "true").when(i % 4 == 1, '"false"').otherwise("null"),
        F.when(i % 5 < 3, part(', "model_codes": [', codes, "]")).otherwise(""), "}",
    )
    return d.products.select("product_id", "category", "brand", F.when(i % 11 == 0, "broken {").when(i % 11 == 1, '[1, "two", null]').otherwise(text).alias("specs"))


FILTERS = {
    "numbers": {"size": [3, 7, 12.0, 40], "Bad Key": 1, "color": ""},
    "brands": {"brand": ["Brand#12", "BRAND#34", "Brand#45"], "oled": True},
    "mixed": {"color": ["Red", "blue", 5], "oled": [False, True], "size": None},
}


@query(f"""{SPECS_SQL}, facts AS (SELECT product_id, lower(coalesce(brand, '')) AS b, CASE WHEN ok AND json_type(j) = 'OBJECT' THEN j->>'size' END AS s, CASE WHEN ok AND json_type(j) = 'OBJECT' THEN lower(j->>'color') END AS c, CASE WHEN ok AND json_type(j) = 'OBJECT' THEN lower(j->>'oled') END AS o FROM valid)
SELECT 'numbers' AS filter, product_id FROM facts WHERE CASE WHEN regexp_matches(s, '^[0-9]+([.][0-9]+)?$') THEN CAST(s AS DOUBLE) END IN (3, 7, 12, 40)
UNION ALL SELECT 'brands', product_id FROM facts WHERE b IN ('brand#12', 'brand#34', 'brand#45') AND o = 'true'
UNION ALL SELECT 'mixed', product_id FROM facts WHERE c IN ('red', 'blue', '5') AND o IN ('true', 'false')""")
def p4_faceted_products(d: Domain):
    rows = specs(d)
    return reduce(DataFrame.unionByName, [rows.where(op.facet_filter(f)).select(F.lit(name).alias("filter"), "product_id") for name, f in FILTERS.items()])


@query(f"""{SPECS_SQL}, o AS (SELECT *, CASE WHEN ok AND json_type(j) = 'OBJECT' THEN json_keys(j) ELSE [] END AS k FROM valid)
SELECT product_id, list_contains(k, 'model_codes') AS has_codes, list_contains(k, 'oled') AS has_oled, list_contains(k, 'gpu') OR list_contains(k, 'model_codes') AS has_any FROM o""")
def p6_has_keys(d: Domain):
    s = F.col("specs")
    return specs(d).select("product_id", op.has_key(s, "model_codes").alias("has_codes"), op.has_key(s, "oled").alias("has_oled"), op.has_any_key(s, ["gpu", "model_codes"]).alias("has_any"))


KINDS_SQL = lambda t: f"CASE WHEN {t} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN {t} = 'VARCHAR' THEN 'string' ELSE lower({t}) END"


@query(f"""{SPECS_SQL} SELECT product_id, {KINDS_SQL("json_type(j)")} AS kind, {KINDS_SQL("json_type(j, '$.size')")} AS size_kind, {KINDS_SQL("json_type(j, '$.oled')")} AS oled_kind,
CASE WHEN json_type(j, '$.model_codes') = 'ARRAY' THEN CAST(json_array_length(j, '$.model_codes') AS INTEGER) END AS n_codes, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(json_array_length(j) AS INTEGER) END AS n FROM valid""")
def p7_kinds(d: Domain):
    s = F.col("specs")
    return specs(d).select("product_id", op.kind(s).alias("kind"), op.kind(s, "size").alias("size_kind"), op.kind(s, "oled").alias("oled_kind"), op.length(s, "model_codes").alias("n_codes"), op.length(s).alias("n"))


@query(f"""{SPECS_SQL} SELECT product_id, CASE WHEN NOT ok THEN NULL WHEN json_type(j) = 'OBJECT' THEN CAST(len(json_keys(j)) + 1 AS INTEGER) ELSE 4 END AS n,
CASE WHEN ok AND json_type(j) = 'OBJECT' THEN 'n' || product_id END AS color, CASE WHEN ok AND json_type(j) = 'OBJECT' THEN j->>'size' END AS size, CASE WHEN ok AND json_type(j) = 'OBJECT' THEN '1' END AS checked FROM valid""")
def p8_merged(d: Domain):
    """New specifications win: another colour, and a key that was missing. A list takes the object in."""
    m = F.col("m")
    new = F.concat(F.lit('{"color": "n'), F.col("product_id").cast("string"), F.lit('", "checked": 1}'))
    rows = specs(d).select("product_id", op.merged(F.col("specs"), new).alias("m"))
    n = F.when(op.kind(m) == "object", F.size(op.entries(m))).otherwise(op.length(m))
    return rows.select("product_id", n.alias("n"), *(op.text_in(m, k).alias(k) for k in ("color", "size", "checked")))


@query(f"""{SPECS_SQL} SELECT product_id, CASE WHEN ok AND json_type(j) = 'OBJECT' THEN j->>'size' END AS size, CASE WHEN ok AND json_type(j) = 'OBJECT' THEN j->>'oled' END AS oled, CAST(NULL AS VARCHAR) AS color,
CASE WHEN ok AND json_type(j) = 'OBJECT' THEN CAST(1 + CASE WHEN j->>'oled' IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) END AS n FROM valid""")
def p12_allowed_specs(d: Domain):
    rows = specs(d).select("product_id", op.allowed(F.col("specs"), ["size", "oled", "gpu"]).alias("out"))
    return rows.select("product_id", *(op.text_in(F.col("out"), k).alias(k) for k in ("size", "oled", "color")), F.size(op.entries(F.col("out"))).alias("n"))


@query("""SELECT 'none' AS asked, category, count(*) AS n FROM products GROUP BY category UNION ALL SELECT 'status', category, count(*) FROM products WHERE status = 'active' GROUP BY category
UNION ALL SELECT 'both', category, count(*) FROM products WHERE status = 'merged' AND category = 'tws' GROUP BY category""")
def p3_optional_filters(d: Domain):
    asked = {"none": (None, None), "status": ("active", None), "both": ("merged", "tws")}
    by = lambda status, category: d.products.where(op.optional("status", status) & op.optional("category", category)).groupBy("category").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [by(*v).select(F.lit(k).alias("asked"), "category", "n") for k, v in asked.items()])


@query("""SELECT listing_id, CAST(round_even(price / 8.0, 2) AS DOUBLE) AS even, CAST(round(CAST(price AS DECIMAL(28,3)) / 8, 2) AS DOUBLE) AS up FROM listings""")
def m3_rounded(d: Domain):
    """Eighths of prices to two digits: ties to even as doubles, ties up as decimals."""
    eighth = F.col("price") / F.lit(8.0)
    return d.listings.select("listing_id", op.half_even(eighth, 2).alias("even"), op.half_up(eighth, 2).cast("double").alias("up"))


@query("""SELECT platform, count(*) AS n_plans, count(*) FILTER (WHERE listing_id % 6 = 0) AS saturated, count(*) FILTER (WHERE page > 8) AS past_deep, max(page) AS max_page, CAST(sum(CASE WHEN listing_id % 7 = 0 THEN 0 ELSE n_seen END) AS BIGINT) AS new_ids
FROM (SELECT *, CASE WHEN listing_id % 9 = 0 THEN 0 ELSE price % 20 END AS page FROM listings WHERE listing_id % 10 NOT IN (0, 1)) GROUP BY platform""")
def r10_depth_snapshot(d: Domain):
    """Plans of catalogue expansion: their state, last page and new ids from nested metadata; some lack paths, some are of other purposes or broken."""
    i = F.col("listing_id")
    cursor = F.concat(F.lit('{"last_page": '), F.when(i % 9 == 0, '"none"').otherwise((F.col("price") % 20).cast("string")), F.when(i % 7 == 0, "").otherwise(F.concat(F.lit(', "new_ids": '), F.col("n_seen").cast("string"))), F.lit("}"))
    purpose = F.when(i % 10 == 0, "other").otherwise("catalog_expansion_v1")
    meta = F.concat(F.lit('{"purpose": "'), purpose, F.lit('", "completion": "'), F.when(i % 6 == 0, "saturated").otherwise("open"), F.lit('", "cursor": '), cursor, F.when(i % 10 == 1, "").otherwise("}"))
    return op.depth_snapshot(d.listings.select("platform", meta.alias("metadata")), "catalog_expansion_v1")
