"""Specifications of phones, refrigerators and washing machines, by literal cases."""

import pytest
from pyspark.sql import functions as F

from pricelore.functions import categories


def found(spark, category, titles):
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    return rows.select(F.struct(*(c.alias(n) for n, c in categories.columns(F.col("title"), category).items())).alias("x"))


CASES = [
    ("refrigerator", "LG 260L Frost Free Double Door Refrigerator GL-S292RDSX", {"brand": "lg", "capacity_l": 260.0, "door_type": "double_door", "frost_type": "frost_free", "star_rating": None}),
    ("refrigerator", "Godrej 180 Ltr Direct-Cool Single Door 4 Star Digital Inverter", {"capacity_l": 180.0, "frost_type": "direct_cool", "door_type": "single_door", "star_rating": 4, "compressor_type": "digital_inverter"}),
    ("washing_machine", "LG 7kg Front Load Fully Automatic Washing Machine FHV1207Z4M", {"family": "lg_front_load", "capacity_kg": 7.0, "dry_capacity_kg": None, "load_type": "front_load", "automation_type": "fully_automatic"}),
    ("washing_machine", "LG 13 kg/10 kg washer dryer front-loading 1400 rpm 5 star inverter", {"capacity_kg": 13.0, "dry_capacity_kg": 10.0, "load_type": "front_load", "rpm": 1400, "star_rating": 5, "inverter": "inverter"}),
    ("washing_machine", "Haier 13-10 kg combo", {"capacity_kg": 13.0, "dry_capacity_kg": 10.0, "family": "haier_washer"}),
    ("smartphone", "Samsung Galaxy S24 Ultra 5G SM-S928B (Burgundy, 256 GB) (12 GB RAM) 6.8 inch", {"brand": "samsung", "family": "galaxy_s24_ultra", "ram_gb": 12, "storage_gb": 256, "color": "burgundy", "display_size_inch": 6.8, "network_generation": "5g"}),
    ("smartphone", "Apple iPhone 15 Pro Max 1 TB Natural Titanium A17", {"brand": "apple", "family": "iphone_15_pro_max", "ram_gb": None, "storage_gb": 1024, "color": "natural", "chipset": "a17"}),
    ("smartphone", None, {"brand": None, "family": None, "ram_gb": None, "storage_gb": None, "color": None}),
]


@pytest.mark.parametrize("category, title, want", CASES)
def test_specs(spark, category, title, want):
    got = found(spark, category, [title]).first().x.asDict()
    assert {k: got[k] for k in want} == want


def test_codes_of_phones(spark):
    rows = found(spark, "smartphone", ["Galaxy SM-S928B", "Oppo CPH2613 120fps", "Sony XQ-DE54 5G", "Apple phone", ""]).collect()
    assert [r.x.model_codes for r in rows] == [["S928B", "SM-S928B"], ["CPH2613"], ["XQ-DE54"], [], []]


PAIRS = [
    ("refrigerator", "LG 260L Double Door RT28C3053S8", "LG 340L Double Door RT28C3053S8", ["capacity_l"]), ("refrigerator", "LG 260L Double Door", "LG 264 l single door", ["door_type"]),
    ("washing_machine", "LG 7kg Front Load Fully Automatic", "LG 9kg Front Load Fully Automatic", ["capacity_kg"]), ("washing_machine", "LG 7kg Front Load Fully Automatic", "LG 7kg Top Load", ["load_type"]),
    ("washing_machine", "LG 7kg", "LG 7.2 kg semi automatic", []), ("smartphone", "iPhone 15 128GB black", "iPhone 15 256GB blue", ["storage_gb", "color"]),
    ("smartphone", "Galaxy SM-S928B 8GB RAM", "Galaxy SM-S921B 12GB RAM", ["model_code", "ram_gb"]), ("smartphone", "iPhone 15", "iPhone 15 256GB blue", []),
]


@pytest.mark.parametrize("category, a, b, want", PAIRS)
def test_hard_conflicts(spark, category, a, b, want):
    pair = found(spark, category, [a]).withColumnRenamed("x", "a").crossJoin(found(spark, category, [b]).withColumnRenamed("x", "b"))
    assert pair.select(categories.hard_conflicts(F.col("a"), F.col("b"), category).alias("c")).first().c == want
