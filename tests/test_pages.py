"""Products and prices in pages by literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from pricelore.operators import browse
from pricelore.operators import pages as op
from pricelore.streaming.activity import kept

FRAGMENT = "text string, price_text string, context string, font_size double, font_weight string, text_decoration string, y double, width double, height double"


def visible(spark, fragments, page_text=None):
    names = [f.split()[0] for f in FRAGMENT.split(", ")]
    rows = None if fragments is None else [tuple(x.get(n) for n in names) for x in fragments]
    kind = ", ".join(f.replace(" ", ":") for f in FRAGMENT.split(", "))
    df = spark.createDataFrame([(1, rows, page_text)], f"id int, fragments array<struct<{kind}>>, page_text string")
    r = op.visible_prices(df, browse.clean_price).first()
    return r.price, r.mrp, r.discount


def fragment(text, y, font_size=28.0, struck=False, context=""):
    return {"text": text, "context": context or text, "font_size": float(font_size), "font_weight": "700", "text_decoration": "line-through" if struck else "none", "y": float(y), "width": 150.0, "height": 36.0}


def test_main_price_and_struck_list_price(spark):
    got = visible(spark, [fragment("₹5,999 per month EMI", 240, 30), fragment("₹69,990", 300), fragment("₹89,990", 305, struck=True)])
    assert got == (69990, 89990, 22.22)


def test_stated_discount_chooses_the_list_price(spark):
    got = visible(spark, [fragment("₹69,990 22% off", 300), fragment("₹89,689", 305, struck=True), fragment("₹1,99,990", 900, struck=True)], "22% off")
    assert got == (69990, 89689, 22.0)


def test_plain_list_price_beside_the_price(spark):
    one = fragment("22% 89,689 ₹69,990", 300, 27, context="22% 89,689 ₹69,990 +₹306 Protect Promise Fee") | {"price_text": "₹69,990"}
    assert visible(spark, [one], "22% 89,689 ₹69,990") == (69990, 89689, 22.0)


def test_no_price(spark):
    assert visible(spark, [fragment("₹69,990", 300, struck=True)], "5% off") == (None, None, 5.0)
    assert visible(spark, [], "was 3% and 40 % off") == (None, None, 40.0)
    assert visible(spark, None) == (None, None, None)
    assert visible(spark, [fragment("₹9,999", 300)]) == (None, None, None)
    assert visible(spark, [fragment("₹20,000 20% off", 300)]) == (20000, 25000, 20.0)
    assert visible(spark, [fragment("₹20,000", 300), {"text": None}, fragment("₹90,000", 300, struck=True)]) == (20000, None, None)


def ld(*values):
    return "".join(f'<script type="application/ld+json">{v if isinstance(v, str) else json.dumps(v)}</script>' for v in values)


def product(name, **more):
    return {"@type": "Product", "name": name} | more


def test_jsonld_of_any_depth(spark):
    deep = product("deep", brand={"name": "b"}, offers={"price": 5.5})
    for _ in range(30):
        deep = {"@graph": [deep]}
    mixed = [[product("a")], {"@type": "ItemList", "itemListElement": [{"item": product("b")}, product("c"), "text", None]}, {"@type": ["Thing", "PRODUCT"], "name": "d", "@graph": [product("e")]}]
    rows = [(1, ld(deep)), (2, ld(mixed)), (3, ld("{", '{"@type": "Product"}}', "", "null", "3", product("f", offers=[], sku=7))), (4, None), (5, ""), (6, ld({"@type": "Thing"}))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id int, html string, path string, name string")
    got = op.jsonld_products(df.drop("path", "name"), kept).orderBy("page_id", "path").collect()
    assert [(r.page_id, r.name, r.price, r.brand, r.sku) for r in got] == [(1, "deep", "5.5", "b", None), *((2, n, None, None, None) for n in "dec" "ba"), (3, "f", None, None, "7")]
    assert op.jsonld_products(spark.createDataFrame([], "page_id int, html string"), kept).collect() == []


def test_hydration_products(spark):
    def page(*blobs):
        return '<script>window.__STATE__ = {"products": [' + ", ".join(b if isinstance(b, str) else json.dumps(b) for b in blobs) + "]};</script>"

    one = page({"name": " Phone ", "price": 0, "sellingPrice": "Rs 12,999", "mrp": "15999"}, {"title": "PHONE", "price": 1}, {"productName": "Case", "id": 5}, '{"name": "bad", }', {"x": {"name": "inner", "price": 700}}, {"name": None, "title": "None"})
    many = page(*({"name": f"n{i}", "price": 1000 + i} for i in range(100)))
    rows = [(1, one), (2, many), (3, "<script>{}</script>"), (4, None), (5, '<script>var a = {"name": "no word of it in here at all"}</script>')]
    got = op.hydration_products(spark.createDataFrame(rows, "page_id int, html string")).orderBy("page_id", "place").collect()
    assert [(r.place, r.title, r.price, r.mrp, r.sku) for r in got if r.page_id == 1] == [(0, "Phone", 12999, 15999, None), (1, "Case", None, None, "5"), (2, "inner", 700, None, None), (3, "None", None, None, None)]
    assert [r.title for r in got if r.page_id == 2] == [f"n{i}" for i in range(80)] and {r.page_id for r in got} == {1, 2}


@pytest.mark.parametrize(
    "html,wanted",
    [
        (ld(product("a", offers={"price": "45,990", "highPrice": 49990, "priceCurrency": "INR"})) + '<meta property="product:price:amount" content="1">', (45990, 49990, "INR", "json_ld")),
        (ld(product("a", offers=[{"price": 10}], mrp=70000)) + '<META name=x property="product:price:amount" content="45990"><meta property=\'product:original_price:amount\' content=\'60000\'>', (45990, 70000, None, "meta")),
        (ld([product("a", price=40000), product("b", price=50000)]), (50000, None, None, "json_ld")),
        ('<meta property="product:price:amount" content="45990"><meta property="product:original_price:amount" content="40000">', (45990, None, None, "meta")),
        ('<span itemprop="price" content="5999.00">', (5999, None, None, "microdata")),
        ('<meta property="product:original_price:amount" content="60000">', (None, 60000, None, None)),
        ("plain", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_price_cascade(spark, html, wanted):
    df = spark.createDataFrame([(1, "laptop", html)], "page_id int, category string, html string")
    r = op.page_prices(df, "page_id", "category", kept).first()
    assert (r.price, r.mrp, r.currency, r.source) == wanted
