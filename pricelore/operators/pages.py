"""Products and prices in web pages: hydration blobs, JSON-LD of any depth, meta and microdata prices, visible prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelore.functions import offers

LD_SCRIPT = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
# A flat object with a name, the shortest script that counts, and most products of a page.
BLOB = r'(\{[^{}]{0,2000}"[^"]*(?:name|title|productName)"[^{}]{0,4000}\})'
SHORTEST, MOST = 40, 80
# Keys of embedded products, first found first.
TITLE_KEYS = ("name", "title", "productName")
PRICE_KEYS = ("price", "sellingPrice", "offerPrice", "finalPrice", "sale_price")
MRP_KEYS = ("mrp", "maxRetailPrice", "listPrice", "wasPrice")
URL_KEYS = ("url", "productUrl", "canonicalUrl", "link", "@id")
SKU_KEYS = ("sku", "productId", "id", "nativeId")
# Prices of shops' meta tags and of microdata.
META = r"""(?i)<meta[^>]+property=["']product:{}["'][^>]+content=["']([^"']+)["']"""
ITEM = r"""(?i)itemprop=["']{}["'][^>]*content=["']([^"']+)["']"""
#: Levels of nested JSON at most; JSON itself ends sooner in practice, and a deeper page is an error, not a loss.
DEEPEST = 1_000


def strict(json: Column | str) -> Column:
    """A text's JSON value (VARIANT); null if it doesn't parse, or if anything follows."""
    alone = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    return F.when(F.size(F.try_variant_get(alone, "$", "array<variant>")) == 1, F.try_variant_get(alone, "$[0]", "variant"))


def text_at(node: Column, *keys: str) -> Column:
    """The first of the keys' values of a JSON object (VARIANT) that isn't null, empty, false or zero, as text."""
    found = []
    for key in keys:
        value, path = F.try_variant_get(node, f'$["{key}"]', "string"), f'$["{key}"]'
        number = F.schema_of_variant(F.try_variant_get(node, path, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (value.cast("double") == 0)
        found.append(F.when((value != "") & (value != "false") & ~F.coalesce(number, F.lit(False)), value))
    return F.coalesce(*found)


def children(node: Column, key: str | None = None) -> Column:
    """The elements of a JSON list (VARIANT), or of the list at a key; none if there is no list."""
    path = "$" if key is None else f'$["{key}"]'
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.array().cast("array<variant>"))


def is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def hydration_products(pages: DataFrame, html: str = "html", most: int = MOST) -> DataFrame:
    """Pages' columns (without html), place (from 0), title, price, mrp, url and sku of the products in the flat JSON objects of a page's scripts.

    Scripts of SHORTEST characters or more that speak of a price or product are searched for objects without nested ones that
    have a name; those that don't parse, and pages without any, give nothing. Of titles that agree in lower case the first
    counts; a page has `most` at most.
    """
    scripts = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(SCRIPT), F.lit(1)), lambda s: (F.length(s) >= SHORTEST) & F.lower(s).rlike("price|product"))
    blobs = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(BLOB), F.lit(1))))
    rows = pages.withColumn("_blobs", blobs).where(F.size("_blobs") > 0).drop(html)
    # titles decide which blobs of a page count, before any row is made
    title = lambda b: F.trim(text_at(F.try_parse_json(b), *TITLE_KEYS))
    named = F.filter(F.transform("_blobs", lambda b: F.struct(title(b).alias("title"), b.alias("blob"))), lambda x: x["title"].isNotNull())
    rows = rows.withColumn("_named", named)
    keys = F.transform("_named", lambda x: F.lower(x["title"]))
    first = F.filter("_named", lambda x, i: F.array_position(F.col("_keys"), F.lower(x["title"])) == i + 1)
    rows = rows.withColumn("_keys", keys).withColumn("_first", F.slice(first, 1, most))
    kept = [c for c in pages.columns if c != html]
    rows = rows.select(*kept, F.posexplode("_first").alias("place", "_one"))
    node = F.col("_node")
    rows = rows.withColumn("_node", F.try_parse_json("_one.blob"))
    return rows.select(*kept, "place", F.col("_one.title").alias("title"), offers.price_in_text(text_at(node, *PRICE_KEYS)).alias("price"), offers.price_in_text(text_at(node, *MRP_KEYS)).alias("mrp"), text_at(node, *URL_KEYS).alias("url"), text_at(node, *SKU_KEYS).alias("sku"))


def jsonld_products(pages: DataFrame, written: Callable[[DataFrame, str], DataFrame], html: str = "html") -> DataFrame:
    """One row for each product in the JSON-LD scripts of pages: pages' columns (without html), path, name, sku, brand, price, mrp and currency.

    Looks into lists, graphs and item lists of any depth: level after level is written with written(df, name), until one is
    empty. path orders a page's products as a walk does that takes the last branch first. Scripts that don't parse, and null
    pages, give nothing. price and mrp are texts.
    """
    kept = [c for c in pages.columns if c != html]
    scripts = pages.select(*kept, F.posexplode(F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1))).alias("_at", "_json"))
    level = scripts.select(*kept, F.array("_at").alias("path"), F.to_json(strict("_json")).alias("_json"))
    found = None
    for _ in range(DEEPEST):
        level = written(level.where(F.col("_json").isNotNull()), "json-level")
        if level.isEmpty():
            break
        parsed = level.withColumn("_node", F.parse_json("_json"))
        node = F.col("_node")
        entries = F.transform(F.filter(children(node, "itemListElement"), is_object), lambda e: F.when(is_object(F.try_variant_get(e, "$.item", "variant")), F.try_variant_get(e, "$.item", "variant")).otherwise(e))
        below = F.concat(children(node), children(node, "@graph"), entries)
        kinds = F.concat(children(node, "@type"), F.when(F.size(children(node, "@type")) == 0, F.array(F.try_variant_get(node, '$["@type"]', "variant"))).otherwise(F.array().cast("array<variant>")))
        product = F.exists(kinds, lambda k: F.lower(F.try_variant_get(k, "$", "string")) == "product")
        here = parsed.where(is_object(node) & F.coalesce(product, F.lit(False))).select(*kept, "path", "_json")
        found = here if found is None else found.unionByName(here)
        level = parsed.select(*kept, "path", F.posexplode(below).alias("_at", "_below")).select(*kept, F.concat("path", F.array(-F.col("_at"))).alias("path"), F.to_json("_below").alias("_json"))
    else:
        raise RuntimeError(f"JSON nested over {DEEPEST} levels deep")
    found = level.select(*kept, "path", "_json") if found is None else found
    node, offer = F.col("_node"), F.col("_offer")
    found = found.withColumn("_node", F.parse_json("_json"))
    found = found.withColumn("_offer", F.coalesce(F.try_variant_get(node, "$.offers[0]", "variant"), F.try_variant_get(node, "$.offers", "variant")))
    texts = {"name": text_at(node, "name", "title"), "sku": text_at(node, "sku", "mpn", "productID"), "brand": F.coalesce(F.try_variant_get(node, "$.brand.name", "string"), F.try_variant_get(node, "$.brand", "string"))}
    texts |= {"price": F.coalesce(text_at(offer, "price"), text_at(node, "price")), "mrp": F.coalesce(text_at(offer, "highPrice"), text_at(node, "mrp")), "currency": text_at(offer, "priceCurrency")}
    return found.select(*kept, "path", *(c.alias(name) for name, c in texts.items()))


def tag(html: Column, pattern: str, name: str) -> Column:
    """The content of the first tag of this pattern and name."""
    return F.nullif(F.regexp_extract(html, pattern.format(name), 1), F.lit(""))


def page_prices(pages: DataFrame, key: str, category: str, written: Callable[[DataFrame, str], DataFrame], html: str = "html") -> DataFrame:
    """key, price, mrp, currency and source (json_ld, meta, microdata or null) of every page; keys are unique.

    The first product in JSON-LD with a price in its category's bounds, else the meta tag's, else the microdata's; the list
    price of that product (of the last one, if none has a price), else the meta tag's. A list price below the price is dropped.
    """
    least, largest = offers.bounds(F.col(category))
    amount = lambda c: offers.price_in_text(c, least, largest)
    products = jsonld_products(pages.select(key, category, html), written, html)
    products = products.select(key, "path", amount(F.col("price")).alias("price"), amount(F.col("mrp")).alias("mrp"), "currency")
    one = F.struct("path", "price", "mrp", "currency")
    by = products.groupBy(key).agg(F.min(F.when(F.col("price").isNotNull(), one)).alias("first"), F.max(one).alias("last")).select(key, F.coalesce("first", "last").alias("ld"))
    doc = F.coalesce(html, F.lit(""))
    texts = {"_meta": tag(doc, META, "price:amount"), "_item": tag(doc, ITEM, "price"), "_list": tag(doc, META, "original_price:amount"), "_meta_unit": tag(doc, META, "price:currency"), "_item_unit": tag(doc, ITEM, "priceCurrency")}
    rows = pages.select(key, category, *(c.alias(name) for name, c in texts.items())).withColumns({c: amount(F.col(c)) for c in ("_meta", "_item", "_list")}).join(by, key, "left")
    ways = [("json_ld", "ld.price", "ld.currency"), ("meta", "_meta", "_meta_unit"), ("microdata", "_item", "_item_unit")]
    currency = F.lit(None).cast("string")
    for _, p, c in reversed(ways):
        currency = F.when(F.col(p).isNotNull(), F.col(c)).otherwise(currency)
    source = F.coalesce(*(F.when(F.col(p).isNotNull(), x) for x, p, _ in ways))
    price, mrp = F.coalesce(*(p for _, p, _ in ways)), F.coalesce("ld.mrp", "_list")
    return rows.select(key, price.alias("price"), F.when(~F.coalesce(mrp < price, F.lit(False)), mrp).alias("mrp"), currency.alias("currency"), source.alias("source"))


# Words around prices that aren't a product's; weights of a fragment's looks; least current price; bounds of list prices.
BAD_CONTEXT = (
    "emi", "per month", "month", "bank", "offer", "cashback", "exchange", "delivery", "fee", "protect", "promise fee", "secure", "warranty", "coupon",
    "extra", "save", "upto", "up to", "minimum", "assured", "free", "buy at", "apply offers", "unbeatable deal", "no cost",
)
BAD_LOSS, STRUCK_LOSS, LEAST_PRICE, LEAST_LISTED, LARGEST_LISTED = 180, 220, 10_000, 5_000, 500_000
PLAIN_PRICE = r"\b[0-9]{1,3}(?:,[0-9]{2,3})+\b"
PERCENT = r"(?i)\b([0-9]{1,2}(?:\.[0-9]+)?)\s*%\s*(?:off|discount)?\b"


def percent_off(text: Column) -> Column:
    """The largest percentage from 1 to 95 in a text."""
    return F.array_max(F.filter(F.transform(F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1)), lambda x: x.cast("double")), lambda x: x.between(1, 95)))


def visible_prices(pages: DataFrame, price_of: Callable[[Column], Column], fragments: str = "fragments", page_text: str = "page_text") -> DataFrame:
    """Adds price, mrp and discount, decided from a page's visible fragments, to pages.

    fragments: an array of structs text, price_text, context, font_size, font_weight, text_decoration, y, width, height; each
    price is price_of its price text, or text. Large, bold and high fragments score more, those in a bad context or struck
    through less. The price is the best one of at least LEAST_PRICE that isn't struck through, of a good context if there is
    one. List prices are struck fragments of a good context, and plain numbers near the price, up to 3.5 times as high; if a
    discount is stated, the one nearest to what it implies, if near enough. Null fields count as missing; null or empty
    arrays give the page's discount alone. One expression over arrays: no rows are made, nothing is shuffled.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    number = lambda c, missing: F.coalesce(F.nullif(c.cast("double"), F.lit(0.0)), F.lit(missing))

    def parsed(x: Column) -> Column:
        bad = F.lit(False)
        for word in BAD_CONTEXT:
            bad = bad | low(x["text"]).contains(word) | low(x["context"]).contains(word)
        struck = low(x["text_decoration"]).contains("line-through")
        raw = F.coalesce(F.nullif(x["font_weight"].cast("string"), F.lit("")), F.lit("400"))
        weight = F.coalesce(raw.try_cast("int"), F.when(F.lower(raw).contains("bold"), 700).otherwise(400))
        y = number(x["y"], 99_999.0)
        looks = number(x["font_size"], 0.0) * 10 + weight / 20 + F.least(number(x["width"], 0.0), F.lit(320.0)) / 20 + F.least(number(x["height"], 0.0), F.lit(80.0)) / 10 - y / 220
        score = looks - F.when(bad, BAD_LOSS).otherwise(0) - F.when(struck, STRUCK_LOSS).otherwise(0)
        price = price_of(F.coalesce(F.nullif(x["price_text"], F.lit("")), x["text"]))
        return F.struct(price.cast("long").alias("price"), struck.alias("struck"), bad.alias("bad"), score.alias("score"), y.alias("y"), F.concat_ws("\n", F.coalesce(x["text"], F.lit("")), low(x["context"])).alias("near"))

    every = F.filter(F.transform(F.coalesce(fragments, F.array().cast(pages.schema[fragments].dataType)), parsed), lambda x: x["price"].isNotNull())
    rows = pages.withColumn("_every", every)
    open_ = F.filter("_every", lambda x: ~x["struck"] & (x["price"] >= LEAST_PRICE))
    good = F.filter(open_, lambda x: ~x["bad"])
    rows = rows.withColumn("_open", F.when(F.size(good) > 0, good).otherwise(open_))
    best = F.filter("_open", lambda x: x["score"] == F.array_max(F.transform("_open", lambda z: z["score"])))
    rows = rows.withColumn("_main", F.get(best, F.lit(0))).withColumn("_main_price", F.col("_main.price"))
    rows = rows.withColumn("_off", F.coalesce(percent_off(F.col("_main.near")), percent_off(F.col(page_text))))
    inferred = F.col("_main_price") / (1 - F.col("_off") / 100)
    inferred = F.when((F.col("_off") > 0) & (F.col("_off") < 95) & (inferred > F.col("_main_price")) & inferred.between(LEAST_LISTED, LARGEST_LISTED), (F.bround(inferred / 10, 0) * 10).cast("long"))
    listed = lambda p: (p > F.col("_main_price")) & (p <= F.col("_main_price") * 3.5)
    struck = F.transform(F.filter("_every", lambda x: x["struck"] & ~x["bad"] & listed(x["price"])), lambda x: F.struct(x["price"].alias("price"), (1_000 - F.abs(x["y"] - F.col("_main.y")) / 40).alias("score"), F.lit(True).alias("struck")))
    plain = F.transform(F.regexp_extract_all(F.col("_main.near"), F.lit(PLAIN_PRICE), F.lit(0)), lambda t: F.regexp_replace(t, ",", "").cast("long"))
    plain = F.transform(F.filter(plain, lambda p: p.between(LEAST_LISTED, LARGEST_LISTED) & listed(p)), lambda p: F.struct(p.alias("price"), F.lit(700.0).alias("score"), F.lit(False).alias("struck")))
    rows = rows.withColumn("_inferred", inferred).withColumn("_listed", F.concat(struck, plain))
    # of one price the candidate with the higher score counts; a plain number loses no tie, as struck ones come first
    rows = rows.withColumn("_listed", F.filter("_listed", lambda c, i: ~F.exists(F.transform("_listed", lambda o, j: F.struct(o.alias("o"), j.alias("j"))), lambda z: (z["o"]["price"] == c["price"]) & ((z["o"]["score"] > c["score"]) | ((z["o"]["score"] == c["score"]) & (z["j"] < i))))))
    near = F.array_min(F.transform("_listed", lambda c: F.struct(F.abs(c["price"] - F.col("_inferred")).alias("far"), (-c["score"]).alias("score"), c["price"].alias("price"))))
    of_struck = F.transform(F.filter("_listed", lambda c: c["struck"]), lambda c: c["price"])
    largest = F.coalesce(F.array_max(of_struck), F.array_max(F.transform("_listed", lambda c: c["price"])))
    fits = near["far"] <= F.greatest(F.lit(1_500.0), F.col("_inferred") * 0.08)
    mrp = F.when(F.size("_listed") == 0, F.col("_inferred")).when(F.col("_inferred").isNotNull() & fits, near["price"]).otherwise(largest)
    rows = rows.withColumn("mrp", F.when(F.col("_main_price").isNotNull(), mrp)).withColumn("price", F.col("_main_price"))
    own = F.round(100.0 * (F.col("mrp") - F.col("price")) / F.col("mrp"), 2)
    discount = F.coalesce("_off", F.when((F.col("mrp") > F.col("price")) & (own > 0) & (own <= 95), own))
    return rows.withColumn("discount", F.when(F.col("price").isNotNull(), discount).otherwise(percent_off(F.col(page_text)))).drop("_every", "_open", "_main", "_main_price", "_off", "_inferred", "_listed")
