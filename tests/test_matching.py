"""Specifications, conflicts and relations of titles, by literal cases."""

import pytest
from pyspark.sql import functions as F

from pricelore.functions import specs
from pricelore.operators import matching


def identities(spark, titles):
    return matching.identities(spark.createDataFrame([(i, "laptop", t) for i, t in enumerate(titles)], "title_id long, category string, title string"))


def test_specs_of_titles(spark):
    titles = [
        "Acer Nitro V 15 Core i5 12th Gen 12450H (16 GB/512 GB SSD) 39.6 cm RTX 3050 Ti ANV15-51",
        "Hewlett Packard 15s 8GB RAM 1.5TB SSD Ryzen AI 7 350", "Blue Star fridge 512GB SSD 8 gbps", None, "Apple MacBook Air M3 Pro 18GB unified 1 TB",
    ]
    rows = matching.with_specs(spark.createDataFrame([(t,) for t in titles], "title string")).collect()
    assert [(r.brand, r.ram_gb, r.storage_gb, r.screen_inch, r.cpu, r.gpu, r.family) for r in rows] == [
        ("acer", 16, 512, 15.6, "intel_core_i:5:12450h", "rtx3050ti", "nitro_v_15"), ("hp", 8, 1536, None, "amd_ryzen:ai:7:350", None, None),
        ("blue star", None, 512, None, None, None, None), (None,) * 7, ("apple", 18, 1024, None, "apple_m:3:pro", None, "macbook_air_m3"),
    ]


@pytest.mark.parametrize("code, normal", [("fx-1234tu", "FX-1234TU"), ("-ab12-", "AB12"), ("QLED", None), ("12345", None), ("123456", "123456"), ("MOBABCDEFGH1", None), ("120fps", None), ("abcdefg", None)])
def test_normal_codes(spark, code, normal):
    assert spark.range(1).select(specs.normal_code(F.lit(code)).alias("c")).first().c == normal


def test_relations_of_identities(spark):
    base = "HP Pavilion 15 FX1234TU Core i5-12450H 8GB RAM 512GB SSD"
    titles = [base, base.replace("8GB", "16GB"), base.replace("i5-12450H", "i7-13650HX"), "HP Pavilion 15 FX1234TU", base.replace("HP Pavilion", "Acer Nitro"), base.replace("Core i5-12450H", "Core 5")]
    found = identities(spark, titles)
    pairs = found.where("title_id = 0").select(F.struct("*").alias("a")).crossJoin(found.where("title_id > 0").select(F.struct("*").alias("b")))
    got = {r.b.title_id: r.relation for r in matching.relations(matching.conflicts(pairs)).collect()}
    assert got == {1: "variant", 2: "variant", 3: "exact", 4: "conflict", 5: "exact"}


def test_copies_of_a_title_do_not_meet(spark):
    found = identities(spark, ["HP Pavilion 15 FX1234TU 8GB RAM"] * 50 + ["HP Pavilion 15 FX1234TU 16GB RAM"] * 50 + ["no code", "no code either"])
    assert [(r.a.title_id, r.b.title_id) for r in matching.code_pairs(found).collect()] == [(0, 50)]
