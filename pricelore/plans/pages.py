"""Queries of products and prices in web pages, with their SQL. They read the given pages; shop markup is added from each page's own title and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelore.operators import browse
from pricelore.operators import pages as op
from pricelore.plans.base import Registry
from pricelore.sources.views import CATEGORIES, Domain, nth, sql_nth
from pricelore.streaming.activity import kept

registry = Registry()
query = registry.query

NAME = "trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z ]', '', 'g'))"
SHOP_SQL = f""", shop AS (SELECT page_id, CASE WHEN {NAME} = '' THEN 'untitled' ELSE {NAME} END AS name, 9000 + page_id * 37 % 60000 AS amount, {sql_nth(CATEGORIES, 'page_id')} AS category, html FROM pages)"""


def shop(d: Domain) -> DataFrame:
    """page_id, name (letters of the page's title), amount, category, html."""
    name = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^A-Za-z ]", ""))
    return d.table("pages").select("page_id", F.when(name == "", "untitled").otherwise(name).alias("name"), (9000 + F.col("page_id") * 37 % 60000).alias("amount"), nth(CATEGORIES, F.col("page_id")).alias("category"), "html")


@query(f"""{SHOP_SQL}, made AS (SELECT page_id, name, amount, unnest([0, 1, 2, 3, 4]) AS i FROM shop),
named AS (SELECT page_id, i, CASE i WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN name || ' two' WHEN 3 THEN name || ' three' ELSE 'broken' END AS title,
  CASE i WHEN 3 THEN amount * 2 WHEN 0 THEN amount END AS price, CASE i WHEN 0 THEN amount + 500 END AS mrp, CASE i WHEN 2 THEN '/p/' || page_id END AS url, CASE i WHEN 0 THEN 's' || page_id END AS sku
  FROM made WHERE i <> 4 AND (i <> 3 OR page_id % 2 = 0)),
first AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(title) ORDER BY i) AS nth FROM named)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS place, title, price, mrp, url, sku FROM first WHERE nth = 1""")
def s8_hydration_products(d: Domain):
    """Each page with a script of embedded products: one, its copy in capitals, one without price, one on even pages, and a broken one."""
    n, a = F.col("name"), F.col("amount")
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    blobs = [
        say('{"name": "', n, '", "price": "₹', a.cast("string"), '", "mrp": ', (a + 500).cast("string"), ', "sku": "s', F.col("page_id").cast("string"), '"}'),
        say('{"title": "', F.upper(n), '", "price": 1}'), say('{"productName": "', n, ' two", "price": 0, "productUrl": "/p/', F.col("page_id").cast("string"), '"}'),
        F.when(F.col("page_id") % 2 == 0, say('{"name": "", "title": " ', n, ' three ", "price": "", "sellingPrice": ', (a * 2).cast("string"), "}")), say('{"name": "broken", "price": }'),
    ]
    script = say('<script id="state">window.state = {"products": [', F.concat_ws(", ", *blobs), "]}</script><script>var price = 1;</script></body>")
    return op.hydration_products(shop(d).select("page_id", F.concat("html", script).alias("html")))


LD = '<script type="application/ld+json">'


def node(price: Column, more: str = "") -> Column:
    return F.concat(F.lit('{"@type": ["Thing", "Product"], "name": "'), F.col("name"), F.lit('", "brand": {"name": "own"}, "offers": [{"price": "'), price.cast("string"), F.lit('", "priceCurrency": "INR"' + more + "}]}"))


@query(f"""{SHOP_SQL} SELECT page_id, name, CAST(amount AS VARCHAR) AS price, 'own' AS brand, 'INR' AS currency, CAST(page_id % 7 + CASE WHEN page_id % 3 = 1 THEN 2 ELSE 0 END + 1 AS INTEGER) AS depth FROM shop WHERE page_id % 4 <> 3""")
def s7_jsonld_products(d: Domain):
    """Each page with a JSON-LD product under up to six graphs, on each third within an item list as well; each fourth is broken."""
    k = (F.col("page_id") % 7).cast("int")
    inner = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit('[{"@type": "ItemList", "itemListElement": [{"item": '), node(F.col("amount")), F.lit("}]}]"))).otherwise(node(F.col("amount")))
    json = F.concat(F.repeat(F.lit('{"@graph": ['), k), inner, F.repeat(F.lit("]}"), k), F.when(F.col("page_id") % 4 == 3, "}").otherwise(""))
    pages = shop(d).select("page_id", F.concat("html", F.lit(LD), json, F.lit("</script>")).alias("html"))
    return op.jsonld_products(pages, kept).select("page_id", "name", "price", "brand", "currency", F.size("path").alias("depth"))


BOUNDS_SQL = "amount >= CASE category WHEN 'camera' THEN 3000 WHEN 'headphones' THEN 500 WHEN 'laptop' THEN 5000 WHEN 'refrigerator' THEN 8000 WHEN 'smartphone' THEN 2000 WHEN 'television' THEN 5000 WHEN 'tws' THEN 500 WHEN 'washing_machine' THEN 5000 ELSE 100 END AND amount <= CASE category WHEN 'headphones' THEN 150000 WHEN 'tws' THEN 80000 ELSE 200000 END"


@query(f"""{SHOP_SQL} SELECT page_id, CASE WHEN page_id % 6 < 5 AND {BOUNDS_SQL} THEN amount END AS price,
  CASE WHEN page_id % 6 IN (0, 1) THEN amount + 1000 WHEN page_id % 6 = 3 THEN CASE WHEN page_id % 2 = 1 THEN amount + 2000 END END AS mrp,
  CASE WHEN page_id % 6 < 4 THEN 'INR' WHEN page_id % 6 = 4 THEN 'EUR' END AS currency,
  CASE page_id % 6 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'json_ld' WHEN 2 THEN 'meta' WHEN 3 THEN 'meta' WHEN 4 THEN 'microdata' END AS source FROM shop""")
def s9_page_prices(d: Domain):
    """Pages with a price in JSON-LD (after a product without), in meta tags (with JSON-LD out of bounds, or alone), in microdata, or nowhere."""
    a = F.col("amount")
    meta = lambda name, c: F.concat(F.lit(f'<meta property="product:{name}" content="'), c.cast("string"), F.lit('">'))
    case = F.col("page_id") % 6
    both = F.concat(F.lit("["), node(a, ', "highPrice": 99999999'), F.lit(","), node(F.lit(1)), F.lit("]"))
    markup = (
        F.when(case == 0, F.concat(F.lit(LD), node(a), F.lit("</script>"), meta("price:amount", F.lit(1)), meta("original_price:amount", a + 1000)))
        .when(case == 1, F.concat(F.lit(LD), both, F.lit("</script>"), meta("original_price:amount", a + 1000)))
        .when(case == 2, F.concat(F.lit(LD), node(F.lit(3)), F.lit("</script>"), meta("price:amount", a), meta("price:currency", F.lit("INR")))).when(case == 3, F.concat(meta("price:amount", a), meta("price:currency", F.lit("INR")), meta("original_price:amount", a + F.when(F.col("page_id") % 2 == 1, 2000).otherwise(-50))))
        .when(case == 4, F.concat(F.lit('<span itemprop="priceCurrency" content="EUR"></span><span itemprop="price" content="'), a.cast("string"), F.lit('"></span>'))).otherwise("<b>no price</b>")
    )
    return op.page_prices(shop(d).select("page_id", "category", F.concat("html", markup).alias("html")), "page_id", "category", kept)


@query(f"""{SHOP_SQL}, base AS (SELECT page_id, amount + 2000 AS p, CASE WHEN page_id % 3 = 0 THEN page_id % 40 + 5 END AS off, page_id % 4 AS kind, CASE WHEN page_id % 5 = 0 THEN 12 END AS page_off FROM shop),
main AS (SELECT *, kind <> 3 OR page_id % 7 = 0 AS shown, coalesce(off, page_off) AS pct FROM base),
listed AS (SELECT page_id, p + 3000 AS v, 1000 - 5 / 40.0 AS score, true AS struck FROM main WHERE kind IN (0, 1) UNION ALL SELECT page_id, p * 3, 1000 - 600 / 40.0, true FROM main WHERE kind = 0 UNION ALL SELECT page_id, p + 4000, 700, false FROM main WHERE kind = 2),
fit AS (SELECT l.*, p, pct, CASE WHEN pct > 0 AND p / (1 - pct / 100.0) BETWEEN 5000 AND 500000 THEN CAST(round_even(p / (1 - pct / 100.0) / 10, 0) * 10 AS BIGINT) END AS inferred FROM listed l JOIN main USING (page_id)),
near AS (SELECT page_id, first(v ORDER BY abs(v - inferred), score DESC, v) AS v, max(v) FILTER (WHERE struck) AS top_struck, max(v) AS top, min(abs(v - inferred)) AS far, any_value(inferred) AS inferred FROM fit WHERE v > p AND v <= p * 3.5 AND (struck OR v BETWEEN 5000 AND 500000) GROUP BY page_id),
decided AS (SELECT m.*, CASE WHEN n.page_id IS NULL THEN CASE WHEN pct > 0 AND p / (1 - pct / 100.0) BETWEEN 5000 AND 500000 THEN CAST(round_even(p / (1 - pct / 100.0) / 10, 0) * 10 AS BIGINT) END
  WHEN n.inferred IS NOT NULL AND far <= greatest(1500, n.inferred * 0.08) THEN n.v ELSE coalesce(top_struck, top) END AS mrp FROM main m LEFT JOIN near n USING (page_id))
SELECT page_id, CASE WHEN shown THEN p END AS price, CASE WHEN shown THEN mrp END AS mrp, CAST(CASE WHEN shown THEN coalesce(pct, round(100.0 * (mrp - p) / mrp, 2)) ELSE page_off END AS DOUBLE) AS discount FROM decided""")
def f25_visible_prices(d: Domain):
    """Fragments of each page: instalments in the largest type, the price, and struck or plain list prices; on some pages only struck ones."""
    i, p = F.col("page_id"), F.col("amount") + 2000
    rupees = lambda c: F.concat(F.lit("₹"), c.cast("string"))
    off = F.when(i % 3 == 0, F.concat((i % 40 + 5).cast("string"), F.lit("% off"))).otherwise("")
    kind, comma = i % 4, F.format_number((p + 4000).cast("long"), 0)

    def fragment(text: Column, y: Column | float, size: float = 28.0, struck: Column | bool = False, context: Column | str = "") -> Column:
        value = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(text.alias("text"), F.lit(None).cast("string").alias("price_text"), value(context).alias("context"), F.lit(size).alias("font_size"), F.lit("700").alias("font_weight"), F.when(value(struck), "line-through solid").otherwise("none").alias("text_decoration"), value(y).cast("double").alias("y"), F.lit(150.0).alias("width"), F.lit(36.0).alias("height"))

    main = fragment(rupees(p), 300.0, struck=(kind == 3) & (i % 7 != 0), context=F.concat_ws(" ", off, F.when(kind == 2, comma)))
    fragments = F.filter(
        F.array(fragment(F.lit("₹15999 per month EMI"), 240.0, 40.0), main, F.when(kind.isin(0, 1), fragment(rupees(p + 3000), 305.0, struck=True)), F.when(kind == 0, fragment(rupees(p * 3), 900.0, struck=True)), fragment(F.lit("no price"), 10.0)),
        lambda x: x.isNotNull() & ~((kind == 3) & (i % 7 != 0) & x["text"].contains("EMI")),
    )
    rows = shop(d).select("page_id", fragments.alias("fragments"), F.when(i % 5 == 0, "now 12% discount").alias("page_text"))
    return op.visible_prices(rows, browse.clean_price).select("page_id", "price", "mrp", "discount")
