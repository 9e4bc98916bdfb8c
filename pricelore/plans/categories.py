"""Queries of specifications and conflicts of phones, refrigerators and washing machines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.functions import categories, specs
from pricelore.plans.base import Registry
from pricelore.sources.views import Domain, nth, sql_nth

registry = Registry()

#: What titles are made of, and by which number of the product each part is chosen.
PARTS = {
    "smartphone": (
        (("Samsung Galaxy S24 Ultra", "Apple iPhone 15 Pro  Max", "Redmi Note 13 Pro", "OnePlus Nord CE 4", "Motorola moto g85", "Google Pixel 8", "POCO X6 Pro"), "n // 4"),
        (("SM-S928B", "CPH2613", "XQ-DE54", "RMX3999", "M2101K7AG", "dual sim"), "n // 4"), (("8GB RAM", "12 GB RAM", "6GB", "10GB RAM"), "n // 4 + n % 2"),
        (("256GB Storage", "128 GB", "1 TB", "512GB ROM"), "n // 2"), (("Snapdragon 8gen", "Dimensity  7200", "A17", "Helio G99", "Exynos 2400", "Snapdragon 695"), "n"),
        (("6.7 inch", "6.1 in", "17 cm"), "n // 4"), (("Burgundy", "Space  Grey", "cosmic orange", "Black", "Mint"), "n // 2"), (("5G", "4G LTE"), "n"),
    ),
    "refrigerator": (
        (("LG", "Samsung", "Whirlpool", "Godrej", "Unbranded"), "n // 4"), (("260L", "340 Litres", "262.5 ltr", "55 l", "601 liter"), "n // 4 + n % 3"), (("Frost Free", "Direct-Cool", "frost"), "n"),
        (("Double Door", "side-by-side", "Single-Door", "French  Door"), "n // 2"), (("3 Star", "5star", "6 star"), "n"), (("Inverter", "Digital Inverter", "non-inverter"), "n // 3"),
        (("GL-S292RDSX", "RT28C3053S8", "WP-IF305", "RD-R200S5"), "n // 4"),
    ),
    "washing_machine": (
        (("LG", "IFB", "Bosch", "Haier", "Unbranded"), "n // 4"), (("7kg", "9 kg", "13-10 kg", "13 kg/10 kg", "6.5 Kg", "12kg / 7.5kg"), "n // 4 + n % 2"),
        (("Front Load", "Top-Loading", "front loading", "TopLoad"), "n // 3"), (("Fully  Automatic", "Semi-Automatic", "automatic"), "n // 2"), (("5 Star", "star"), "n"),
        (("1400 rpm", "700RPM", "rpm"), "n"), (("Inverter", "digital inverter", "motor"), "n // 2"), (("FHV1207Z4M", "T70SKSF1Z", "WAJ2846WIN"), "n // 4"),
    ),
}
TITLES_SQL = ""
for at, (kind, parts) in enumerate(PARTS.items()):
    words = ", ".join(f"CASE WHEN (n + {i}) % 7 <> 0 THEN {sql_nth(values, index)} END" for i, (values, index) in enumerate(parts))
    TITLES_SQL += f""", t{at} AS (SELECT product_id AS title_id, product_id // 4 AS family_id, concat_ws(' ', {words}) AS title FROM (SELECT *, product_id AS n FROM products)),
b{at} AS MATERIALIZED (SELECT title_id, family_id, title, brand, raw_codes FROM (SELECT *, {specs.sql_columns("title")} FROM t{at})), {kind}s AS MATERIALIZED (SELECT title_id, family_id, brand, {categories.sql_columns("title", kind)} FROM b{at})"""


def titles(d: Domain, category: str) -> DataFrame:
    """title_id, family_id (of four products), title: one title of the category for each product, each without some of the parts."""
    n = F.col("product_id")
    words = [F.when((n + i) % 7 != 0, nth(values, F.expr(index.replace("//", "div").replace("n", "product_id")))) for i, (values, index) in enumerate(PARTS[category])]
    return d.products.select(n.alias("title_id"), F.call_function("div", n, F.lit(4)).alias("family_id"), F.concat_ws(" ", *words).alias("title"))


def register(category: str) -> None:
    """f15_<category>_specs, and f37_<category>_conflicts of each title with the first one of its family (never all pairs)."""

    def with_specs(d: Domain) -> DataFrame:
        found = titles(d, category)
        return found.select("title_id", "family_id", *(c.alias(name) for name, c in categories.columns(F.col("title"), category).items()))

    def found_specs(d: Domain) -> DataFrame:
        return with_specs(d).withColumn("model_codes", F.array_join("model_codes", ",")).drop("family_id")

    def conflicts(d: Domain) -> DataFrame:
        rows = with_specs(d).select("family_id", F.col("title_id"), F.struct("*").alias("x"))
        first = rows.groupBy("family_id").agg(F.min_by("x", "title_id").alias("first"))
        found = rows.join(first, "family_id").where("title_id > first.title_id")
        named = categories.hard_conflicts(F.col("first"), F.col("x"), category)
        return found.select("title_id", F.col("first.title_id").alias("other_id"), F.array_join(named, ",").alias("conflicts"))

    found_specs.__name__, conflicts.__name__ = f"f15_{category}_specs", f"f37_{category}_conflicts"
    registry.query(f"{TITLES_SQL} SELECT title_id, brand, array_to_string(model_codes, ',') AS model_codes, {', '.join(categories.NAMES[category])} FROM {category}s")(found_specs)
    registry.query(f"""{TITLES_SQL} SELECT b.title_id, a.title_id AS other_id, {categories.sql_hard_conflicts("a", "b", category)} AS conflicts FROM {category}s b
JOIN {category}s a ON a.family_id = b.family_id AND a.title_id = (SELECT min(title_id) FROM {category}s m WHERE m.family_id = b.family_id) WHERE b.title_id > a.title_id""")(conflicts)


for name in PARTS:
    register(name)
