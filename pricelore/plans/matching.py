"""Queries of titles' specifications and of product identities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.functions import specs
from pricelore.operators import matching
from pricelore.plans.base import Registry
from pricelore.sources.views import Domain, nth, sql_nth

registry = Registry()
query = registry.query

LINES = ("HP Pavilion", "Lenovo IdeaPad Slim", "ASUS Vivobook", "Acer Nitro V", "Dell Inspiron", "Lenovo ThinkPad E", "Hewlett Packard Omen", "Asus TUF Gaming F")
CHIPS = ("Intel Core i5-12450H", "Intel Core i7 13th Gen 13650HX", "AMD Ryzen 5 5600H", "Intel Core 7-240H", "Intel Core i5 12th Gen", "AMD Ryzen AI 7 350", "Core Ultra 5 125H", "Apple M3 Pro")
MEMORY, DISKS = ("8GB", "16 GB", "32GB"), ("512GB SSD", "1TB SSD", "256 GB NVMe")
SCREENS, CARDS = ("15.6 inch", "14 inch", "39.6 cm", "16 inch"), ("RTX 3050", "RTX 4060 Ti", "Iris Xe", "Radeon RX 6500M")
SERIES = ("IRX", "IAX", "ACH", "ITL", "IMH", "ARP", "ALC")


def titles(d: Domain) -> DataFrame:
    """title_id, category, title: three offers of each group of three products, that name more or fewer specifications."""
    p = d.products.select(F.col("product_id").alias("n"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("v"))
    g = F.call_function("div", F.col("n"), F.lit(3))
    line = F.concat(nth(LINES, g), F.lit(" "), (g % 89 + 10).cast("string"))
    code = F.when(g % 5 == 0, F.concat((g % 4 + 13).cast("string"), nth(SERIES, g), (g % 10).cast("string"))).otherwise(F.concat(F.lit("FX"), (g % 9000 + 1000).cast("string"), F.lit("TU")))
    sizes = F.concat(nth(MEMORY, F.col("n")), F.lit(" RAM "), nth(DISKS, g + F.col("n") % 2))
    rest = F.concat_ws(" ", nth(SCREENS, g), nth(CARDS, g + F.call_function("div", F.col("n"), F.lit(2)) % 2))
    title = (
        F.when(F.col("v") == 0, F.concat_ws(" ", line, code, nth(CHIPS, g), sizes, rest, F.lit("Windows 11")))
        .when(F.col("v") == 1, F.concat_ws(" ", line, code, sizes)).otherwise(F.concat_ws(" ", line, nth(CHIPS, g), F.lit("/"), sizes))
    )
    return p.select((F.col("n") * 3 + F.col("v")).alias("title_id"), F.lit("laptop").alias("category"), title.alias("title"))


G = "(n // 3)"
LINE_SQL = f"{sql_nth(LINES, G)} || ' ' || ({G} % 89 + 10)"
CODE_SQL = f"CASE WHEN {G} % 5 = 0 THEN ({G} % 4 + 13) || {sql_nth(SERIES, G)} || ({G} % 10) ELSE 'FX' || ({G} % 9000 + 1000) || 'TU' END"
SIZES_SQL = f"{sql_nth(MEMORY, 'n')} || ' RAM ' || {sql_nth(DISKS, f'{G} + n % 2')}"
REST_SQL = f"{sql_nth(SCREENS, G)} || ' ' || {sql_nth(CARDS, f'{G} + (n // 2) % 2')}"
TITLES_SQL = f""", titles AS MATERIALIZED (SELECT n * 3 + v AS title_id, 'laptop' AS category,
  CASE v WHEN 0 THEN {LINE_SQL} || ' ' || {CODE_SQL} || ' ' || {sql_nth(CHIPS, G)} || ' ' || {SIZES_SQL} || ' ' || {REST_SQL} || ' Windows 11'
    WHEN 1 THEN {LINE_SQL} || ' ' || {CODE_SQL} || ' ' || {SIZES_SQL} ELSE {LINE_SQL} || ' ' || {sql_nth(CHIPS, G)} || ' / ' || {SIZES_SQL} END AS title
  FROM (SELECT product_id AS n, unnest([0, 1, 2]) AS v FROM products)),
specs AS MATERIALIZED (SELECT title_id, category, title, {specs.sql_columns("title")} FROM titles)"""
SHA = lambda *parts: "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '?')" for p in parts) + "))"
LINE_OF = "coalesce(family, lower(regexp_extract(model_codes[1], '^([^-_/]*)', 1)))"
IDENTITIES_SQL = f"""{TITLES_SQL}, identities AS MATERIALIZED (SELECT *,
  {SHA("category", "brand", "array_to_string(model_codes, ',')", "cpu", "ram_gb", "storage_gb", "CAST(round(screen_inch * 10) AS INTEGER)", "gpu", "CASE WHEN len(model_codes) = 0 THEN lower(title) ELSE '' END")} AS exact_fingerprint,
  CASE WHEN brand IS NOT NULL AND {LINE_OF} IS NOT NULL THEN {SHA("category", "brand", LINE_OF)} END AS family_fingerprint FROM specs)"""
CPU_SQL = lambda x: f"regexp_replace({x}.cpu, '^intel_core_(?:i|new)(:|$)', 'intel_core\\1')"
TIER_SQL = lambda x: f"regexp_extract({CPU_SQL(x)}, '(?:^|:)(pro|max|ultra)$', 1)"
SERIES_SQL = lambda x: f"regexp_extract({x}.cpu, '^([^:]*(?::[^:]*)?(?::[^:]*)?)', 1)"
PAIRS_SQL = f"""{IDENTITIES_SQL}, one AS (SELECT * FROM identities WHERE title_id IN (SELECT min(title_id) FROM identities GROUP BY exact_fingerprint)),
coded AS (SELECT title_id, unnest(model_codes) AS code FROM one),
met AS (SELECT DISTINCT x.title_id AS i, y.title_id AS j FROM coded x JOIN coded y ON x.code = y.code AND x.title_id < y.title_id),
flags AS MATERIALIZED (SELECT i, j, coalesce(a.brand <> b.brand, false) AS brand_conflict,
  len(a.model_codes) > 0 AND len(b.model_codes) > 0 AND len(list_intersect(a.model_codes, b.model_codes)) = 0 AS model_conflict,
  coalesce(a.ram_gb <> b.ram_gb, false) AS ram_conflict, coalesce(a.storage_gb <> b.storage_gb, false) AS storage_conflict,
  coalesce(abs(a.screen_inch - b.screen_inch) > {matching.SCREEN_TOLERANCE}, false) AS screen_conflict,
  NOT coalesce({CPU_SQL("a")} = {CPU_SQL("b")} OR ({TIER_SQL("a")} = {TIER_SQL("b")} AND (starts_with({CPU_SQL("a")}, {CPU_SQL("b")} || ':') OR starts_with({CPU_SQL("b")}, {CPU_SQL("a")} || ':'))), true) AS cpu_conflict,
  coalesce(a.gpu <> b.gpu, false) AS gpu_conflict, list_intersect(a.model_codes, b.model_codes) AS shared, coalesce(a.gpu = b.gpu, false) AS same_gpu,
  a.exact_fingerprint = b.exact_fingerprint AS same_exact, coalesce(a.family_fingerprint = b.family_fingerprint, false) AS same_family,
  coalesce(a.brand = b.brand, false) AND (a.family IS NOT DISTINCT FROM b.family OR {SERIES_SQL("a")} IS NOT DISTINCT FROM {SERIES_SQL("b")}) AS akin
  FROM met JOIN one a ON a.title_id = i JOIN one b ON b.title_id = j)"""


@query(f"{TITLES_SQL} SELECT title_id, brand FROM specs")
def f13_brand(d: Domain):
    return titles(d).select("title_id", specs.brand(F.col("title")).alias("brand"))


@query(f"{TITLES_SQL} SELECT title_id, ram_gb, storage_gb, screen_inch, generation, cpu, gpu, family FROM specs")
def f15_laptop_specs(d: Domain):
    found = matching.with_specs(titles(d))
    return found.select("title_id", "ram_gb", "storage_gb", "screen_inch", specs.generation(F.col("title")).alias("generation"), "cpu", "gpu", "family")


@query(f"""{TITLES_SQL} SELECT title_id, array_to_string(model_codes, ',') AS model_codes,
array_to_string(list_sort(list_distinct(list_filter(list_transform(raw_codes, lambda c: {specs.sql_normal_code("c")}), lambda c: c IS NOT NULL))), ',') AS normal_codes FROM specs""")
def f17_model_codes(d: Domain):
    codes = specs.raw_codes(F.col("title"))
    normal = F.array_sort(F.array_distinct(F.filter(F.transform(codes, specs.normal_code), lambda c: c.isNotNull())))
    return titles(d).select("title_id", F.array_join(specs.model_codes(F.col("title")), ",").alias("model_codes"), F.array_join(normal, ",").alias("normal_codes"))


@query(f"{IDENTITIES_SQL} SELECT title_id, exact_fingerprint, family_fingerprint FROM identities")
def c34_identities(d: Domain):
    return matching.identities(titles(d)).select("title_id", "exact_fingerprint", "family_fingerprint")


FLAGS = ("brand", "model", "ram", "storage", "screen", "cpu", "gpu")


@query(f"{PAIRS_SQL} SELECT i AS title_id, j AS other_id, concat_ws(',', {', '.join(f'''CASE WHEN {x}_conflict THEN '{x}' END''' for x in FLAGS)}) AS conflicts FROM flags")
def f37_hard_conflicts(d: Domain):
    found = matching.conflicts(matching.code_pairs(matching.identities(titles(d))))
    return found.select(F.col("a.title_id").alias("title_id"), F.col("b.title_id").alias("other_id"), F.concat_ws(",", *(F.when(F.col(f"{x}_conflict"), x) for x in FLAGS)).alias("conflicts"))


@query(f"""{PAIRS_SQL}, judged AS (SELECT *, NOT (ram_conflict OR storage_conflict OR screen_conflict OR cpu_conflict OR gpu_conflict) AS clear,
  len(list_filter(shared, lambda c: NOT regexp_matches(c, '{specs.WEAK_CODE}'))) > 0 AS strong FROM flags)
SELECT i AS title_id, j AS other_id, CASE WHEN brand_conflict THEN 'conflict' WHEN strong AND clear THEN 'exact'
  WHEN len(shared) > 0 AND NOT strong AND clear THEN CASE WHEN same_gpu THEN 'exact' ELSE 'related' END WHEN same_exact THEN 'exact'
  WHEN same_family THEN CASE WHEN NOT clear OR model_conflict THEN 'variant' ELSE 'exact' END WHEN akin THEN 'related'
  WHEN model_conflict AND cpu_conflict THEN 'conflict' ELSE 'related' END AS relation FROM judged""")
def c35_relations(d: Domain):
    found = matching.relations(matching.conflicts(matching.code_pairs(matching.identities(titles(d)))))
    return found.select(F.col("a.title_id").alias("title_id"), F.col("b.title_id").alias("other_id"), "relation")
