"""Causes of several offers, by literal groups."""

import itertools
import random

from pricelore.operators import duplicates as op

ROWS = "group_id string, category string, is_product boolean, title string, brand string, ram_gb int, storage_gb int, screen_inch double, cpu string, gpu string, color string, kit string, model_codes array<string>, native_id string, url string"


def row(group, category="laptop", product=False, title="t", brand=None, ram=None, storage=None, screen=None, cpu=None, gpu=None, color=None, kit=None, codes=(), native=None, url=None):
    return (group, category, product, title, brand, ram, storage, screen, cpu, gpu, color, kit, list(codes) or None, native, url)


def test_causes(spark):
    i5 = "intel_core_i:5"
    groups = {
        "color": ("C", [dict(category="smartphone", color="blue"), dict(category="smartphone", color="red")]), "ram": ("D", [dict(ram=8, product=True), dict(ram=16), dict()]), "storage": ("D", [dict(storage=256), dict(storage=512)]),
        "screen": ("E", [dict(screen=14.0), dict(screen=15.6)]), "near": ("B", [dict(screen=15.5, native="1"), dict(screen=15.6, native="2")]), "kit": ("F", [dict(category="camera", kit="body"), dict(category="camera", kit="lens")]),
        "gpu": ("G", [dict(gpu="rtx3050"), dict(gpu="rtx4060")]), "cpu": ("G", [dict(cpu=i5), dict(cpu=i5 + ":12450h"), dict(cpu=i5 + ":13450hx")]), "codes": ("G", [dict(codes=["A1"]), dict(codes=["A1", "B2"]), dict(codes=["B2"])]),
        "no codes": ("A", [dict(codes=["A1"]), dict(codes=["A1", "B2"]), dict()]), "accessory": ("H", [dict(category="tws", brand="sony", title="Case"), dict(category="tws", brand="boat")]),
        "native": ("A", [dict(native="1", url="http://x/a"), dict(native="1", url="http://x/b")]), "url": ("A", [dict(native="1", url="http://x/a"), dict(native="2", url="http://x/a")]),
        "path": ("B", [dict(native="1", url="http://x/a?c=1"), dict(native="2", url="http://x/a/?c=2")]), "agree": ("G", [dict(cpu=i5, native="1"), dict(cpu=i5 + ":12450h", native="2")]),
        "soft": ("B", [dict(category="tws", color="blue", native="1"), dict(category="tws", color="red", native="2")]), "other": ("J", [dict(category="camera", color="blue", native="1"), dict(category="camera", color="red", native="2")]),
        "single": ("A", [dict(native="1", url="http://x/a")]), "nothing": ("A", [dict(), dict()]), "product alone": (None, [dict(product=True)]),
    }
    rows = [row(g, **r) for g, (_, members) in groups.items() for r in members]
    got = {r.group_id: r.cause for r in op.causes(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {g: cause for g, (cause, _) in groups.items() if cause}
    assert op.causes(spark.createDataFrame([], ROWS)).count() == 0


def test_code_conflicts_equal_all_pairs(spark):
    random.seed(5)
    groups = {str(g): [random.sample("ABCDE", random.randint(0, 3)) for _ in range(random.randint(1, 6))] for g in range(80)}
    rows = spark.createDataFrame([row(g, codes=sorted(s)) for g, sets in groups.items() for s in sets], ROWS)
    want = {g for g, sets in groups.items() if any(a and b and not set(a) & set(b) for a, b in itertools.combinations(sets, 2))}
    assert {r.group_id for r in op.code_conflicts(rows).collect()} == want
