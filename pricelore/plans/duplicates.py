"""The query of why products have several offers of one shop, with its SQL (which compares all pairs of a group)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.functions import categories
from pricelore.operators import duplicates as op
from pricelore.operators import matching
from pricelore.plans import categories as phones
from pricelore.plans.base import Registry
from pricelore.plans.matching import CPU_SQL, IDENTITIES_SQL, TIER_SQL, titles
from pricelore.sources.views import Domain
from pricelore.streaming.activity import kept

registry = Registry()
query = registry.query

COLUMNS = ("group_id", "category", "is_product", "title", "brand", "ram_gb", "storage_gb", "screen_inch", "cpu", "gpu", "color", "kit", "model_codes", "native_id", "url")


def offers(d: Domain) -> DataFrame:
    """Offers of laptops, by product or by three of them, and of phones, by four; the first title of a group is the product's."""
    n = F.call_function("div", F.col("title_id"), F.lit(3))
    g = F.call_function("div", n, F.lit(3))
    group = F.when(g % 3 == 0, F.concat(F.lit("l"), g)).otherwise(F.concat(F.lit("m"), n))
    laptops = matching.with_specs(titles(d)).withColumns({"group_id": group, "color": F.lit(None).cast("string")})
    named = phones.titles(d, "smartphone")
    phone = named.select("title_id", "title", F.lit("smartphone").alias("category"), F.concat(F.lit("p"), "family_id").alias("group_id"), *(c.alias(k) for k, c in categories.columns(F.col("title"), "smartphone").items()))
    phone = phone.withColumns({"screen_inch": F.lit(None).cast("double"), "cpu": F.lit(None).cast("string"), "gpu": F.lit(None).cast("string")})
    same = ("title_id", "group_id", "category", "title", "brand", "ram_gb", "storage_gb", "screen_inch", "cpu", "gpu", "color", "model_codes")
    rows = laptops.select(*same).unionByName(phone.select(*same))
    t = F.col("title_id")
    return rows.withColumns({
        "is_product": t % 3 == 0, "kit": F.lit(None).cast("string"), "native_id": F.when(t % 5 == 0, None).when(t % 4 < 2, F.col("group_id")).otherwise(t.cast("string")),
        "url": F.concat(F.lit("https://shop.example/"), F.when(F.length("group_id") % 2 == 0, F.col("group_id")).otherwise((t % 2).cast("string")), F.lit("?v="), (t % 7).cast("string")),
    }).select(*COLUMNS)


PLACE = "CASE WHEN title_id % 5 = 0 THEN NULL WHEN title_id % 4 < 2 THEN group_id ELSE CAST(title_id AS VARCHAR) END AS native_id, 'https://shop.example/' || CASE WHEN length(group_id) % 2 = 0 THEN group_id ELSE CAST(title_id % 2 AS VARCHAR) END AS path, title_id % 7 AS v"
LISTED = "FILTER (NOT is_product)"


@query(f"""{IDENTITIES_SQL}{phones.TITLES_SQL}, both_kinds AS (
  SELECT title_id, CASE WHEN title_id // 9 % 3 = 0 THEN 'l' || (title_id // 9) ELSE 'm' || (title_id // 3) END AS group_id, category, title, brand, ram_gb, storage_gb, screen_inch, cpu, gpu, NULL AS color, model_codes FROM identities
  UNION ALL SELECT s.title_id, 'p' || s.family_id, 'smartphone', t.title, s.brand, s.ram_gb, s.storage_gb, NULL, NULL, NULL, s.color, s.model_codes FROM smartphones s JOIN t0 t ON t.title_id = s.title_id),
rows_ AS MATERIALIZED (SELECT *, title_id % 3 = 0 AS is_product, {PLACE} FROM both_kinds),
pairs AS (SELECT a.group_id, a.category, bool_or(a.color <> b.color) AS colors, bool_or(a.ram_gb <> b.ram_gb OR a.storage_gb <> b.storage_gb) AS memory,
    bool_or(a.category = 'laptop' AND abs(a.screen_inch - b.screen_inch) > {matching.SCREEN_TOLERANCE}) AS screens, bool_or(a.brand <> b.brand) AS brands,
    bool_or(len(a.model_codes) > 0 AND len(b.model_codes) > 0 AND len(list_intersect(a.model_codes, b.model_codes)) = 0) AS codes, bool_or(a.gpu <> b.gpu) AS gpus,
    bool_or(NOT ({CPU_SQL("a")} = {CPU_SQL("b")} OR ({TIER_SQL("a")} = {TIER_SQL("b")} AND (starts_with({CPU_SQL("a")}, {CPU_SQL("b")} || ':') OR starts_with({CPU_SQL("b")}, {CPU_SQL("a")} || ':'))))) AS cpus
  FROM rows_ a JOIN rows_ b ON a.group_id = b.group_id GROUP BY a.group_id, a.category),
counted AS (SELECT group_id, count(*) {LISTED} AS n, count(DISTINCT native_id) {LISTED} AS natives, count(DISTINCT path || v) {LISTED} AS urls, count(DISTINCT path) {LISTED} AS paths,
    count(DISTINCT color) {LISTED} AS own_colors, count(DISTINCT ram_gb) {LISTED} AS rams, count(DISTINCT storage_gb) {LISTED} AS storages, count(DISTINCT cpu) {LISTED} AS own_cpus, count(DISTINCT gpu) {LISTED} AS own_gpus,
    bool_or(regexp_matches(lower(title), '{op.ACCESSORY}')) {LISTED} AS accessory FROM rows_ GROUP BY group_id)
SELECT group_id, category, n, CASE WHEN category = 'smartphone' AND colors THEN 'C' WHEN memory THEN 'D' WHEN screens THEN 'E' WHEN category = 'laptop' AND (coalesce(gpus, false) OR coalesce(cpus, false) OR codes) THEN 'G'
  WHEN (brands OR codes) AND accessory THEN 'H' WHEN n > 1 AND (natives = 1 OR urls = 1) THEN 'A' WHEN n > 1 AND paths = 1 THEN 'B' WHEN category = 'laptop' AND (own_cpus > 1 OR own_gpus > 1) THEN 'G'
  WHEN own_colors <= 1 AND rams <= 1 AND storages <= 1 THEN CASE WHEN natives > 1 OR urls > 1 THEN 'B' ELSE 'A' END ELSE 'J' END AS cause
FROM pairs JOIN counted USING (group_id) WHERE n > 0""")
def r8_duplicate_causes(d: Domain):
    return op.causes(kept(offers(d), "r8-offers"))  # read by three branches: specifications are found once
