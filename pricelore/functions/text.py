"""Column functions on titles, prices, URLs, stock texts and search queries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a title doesn't need, and parameters that only track.
NOISE = (
    r"\b(laptop|notebook|computer|pc|anti[\s-]?glare|backlit|thin|light|ultra[\s-]?slim|gaming|portable|slim|premium|business|standard|smartchoice|"
    r"silver|black|grey|gray|blue|gold|natural|starry|midnight|moonlight|graphite|titanium|platinum|arctic|cool|mixed|mica|glacier|previously|powered\s+by|"
    r"windows\s*[0-9]*|home|office|microsoft|ms\b|with|for|and|the|best|new|latest|full\s*hd|fhd|wuxga|oled|ips|display|screen|inch|cm|kg)\b"
)
TRACKING = (
    "gclid", "fbclid", "ref", "tag", "src", "source", "spm", "srsltid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "qid", "psc", "pd_rd_w", "pd_rd_r", "pd_rd_wg", "internal_source", "otracker", "fm", "iid", "ppt", "ppn", "ssid", "qH", "marketplace", "srno",
)
SPACES, SYMBOLS, NOT_ASCII = r"[\x09-\x0D\x1C-\x20]+", r"[^a-z0-9_.\x09-\x0D\x1C-\x20-]", r"[^\x00-\x7F]"


def foldings(end: int = 0x10000) -> tuple[str, str]:
    """The letters before code point `end` whose compatibility decomposition leaves one ASCII character, and these characters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0x80, end) if not 0xD800 <= c < 0xE000]
    kept = [(c, to) for c, to in pairs if len(to) == 1]
    return "".join(c for c, _ in kept), "".join(to for _, to in kept)


ACCENTS, PLAIN = foldings()


def fold(text: Column) -> Column:
    """Lower-case ASCII: accents fall, letters that decompose to one ASCII character become it, all others are left out."""
    return F.lower(F.regexp_replace(F.translate(text, ACCENTS, PLAIN), NOT_ASCII, ""))


def normalise_title(text: Column) -> Column:
    """Folded, & as and, symbols but - . _ and noise words out, single blanks."""
    plain = F.regexp_replace(F.regexp_replace(fold(text), "&", " and "), SYMBOLS, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, NOISE, " "), SPACES, " "))


def title_tokens(text: Column) -> Column:
    """Different words of two characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalise_title(text), " "), lambda t: F.length(t) >= 2)))


def parse_price(text: Column, low: int = 1, high: int = 10_000_000) -> Column:
    """The first number, with commas as separators of thousands, if within bounds; in whole units."""
    number = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*)", 1), ",", "")
    value = F.when(F.length(number).between(1, 12), number.cast("long"))
    return F.when(value.between(low, high), value)


def parse_discount(text: Column) -> Column:
    """The first percentage from 1 to 95."""
    value = F.regexp_extract(text, r"([0-9]{1,3}) ?%", 1)
    number = F.when(value != "", value.cast("int"))
    return F.when(number.between(1, 95), number)


def discount_percent(price: Column, listed: Column) -> Column:
    """Two decimals, above 0 and up to 95; else null."""
    value = F.round(100.0 * (listed - price) / listed, 2)
    return F.when((listed > 0) & (price > 0) & (value > 0) & (value <= 95), value)


def normalise_url(url: Column) -> Column:
    """Lower scheme and host, without tracking parameters, fragment and slashes at the end; parameters keep their order."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), "/+", "/"), "/$", "")
    given = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    query = F.array_join(given, "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def native_id(url: Column) -> Column:
    """The last number of the path."""
    return F.nullif(F.regexp_extract(url, r"/([0-9]+)(?:[/?#].*)?$", 1), F.lit(""))


def listing_key(platform: Column, url: Column, title: Column) -> Column:
    """Of the native id, else the URL's hash, else the title's."""
    digest = lambda c: F.substring(F.sha1(c), 1, 16)
    return F.coalesce(F.concat(platform, F.lit(":"), native_id(url)), F.concat(platform, F.lit(":u:"), digest(normalise_url(url))), F.concat(platform, F.lit(":t:"), digest(normalise_title(title))))


def ladder(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The value of the first rule (pattern, value) whose pattern occurs."""
    out = F.lit(otherwise)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


# The rules' order decides.
CATEGORY_RULES = [
    (r"\b(case|cover|screen protector|tempered glass|sleeve|bag|stand|cable|charger|adapter)\b", "accessory"), (r"\b(soundbar|headphone|headphones|headset|wh-[0-9]+)", "headphones"),
    (r"\b(earbuds|buds|tws|true wireless|wf-[0-9]+)", "tws"), (r"\b(washing machine|front load|top load)\b", "washing_machine"), (r"\b(refrigerator|fridge|double door)\b", "refrigerator"),
    (r"\b(laptop|notebook|macbook|chromebook)\b", "laptop"), (r"\b(television|smart tv|led tv|oled tv|qled|[0-9]{2} inch)\b", "television"), (r"\b(camera|dslr|mirrorless|eos)\b", "camera"),
    (r"\b(smartphone|phone|iphone|galaxy s[0-9]+|5g)\b", "smartphone"),
]
STOCK_RULES = [
    (r"captcha|robot check|access denied", "challenge"), (r"not available in your area|enter pincode", "unknown"), (r"add to cart|buy now|in stock", "in_stock"),
    (r"currently unavailable|out of stock|sold out|notify me", "out_of_stock"),
]
BLOCKED = r"captcha|access denied|are you a robot|unusual traffic|cloudflare"


def category_of(title: Column) -> Column:
    return ladder(fold(title), CATEGORY_RULES, "unknown")


def stock_of(text: Column) -> Column:
    return ladder(F.lower(text), STOCK_RULES, "unknown")


def is_blocked(html: Column) -> Column:
    return F.lower(html).rlike(BLOCKED)


def units(number: Column, unit: Column) -> Column:
    return (number.cast("double") * F.when(unit == "k", 1_000).when(unit.startswith("l"), 100_000).otherwise(1)).cast("long")


def price_intent(query: Column) -> Column:
    """A struct low, high (long, null if open) from between, under, below, above, over and budget, with k and lakh."""
    text = F.lower(query)
    number, unit = r"([0-9]+(?:\.[0-9]+)?) ?(k|lakh|l)?\b"[:-2], ""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    both = rf"between {number}{unit} and {number}"
    under, above = rf"(?:under|below|within|budget) {number}", rf"(?:above|over|from) {number}"
    value = lambda pattern, i: F.when(part(pattern, i) != "", units(part(pattern, i), part(pattern, i + 1)))
    return F.struct(F.coalesce(value(both, 1), value(above, 1)).alias("low"), F.coalesce(value(both, 3), value(under, 1)).alias("high"))


# What words of a query add to a candidate of a category.
INTENTS = [
    ("gaming", "laptop", r"rtx|gtx|rog|legion|nitro|omen", 48.0, -36.0), ("oled", "television", r"oled", 24.0, -12.0), ("front load", "washing_machine", r"front load", 12.0, -12.0), ("anc", "tws", r"anc|noise cancel", 18.0, 0.0),
]


def intent_score(query: Column, category: Column, text: Column) -> Column:
    """Sum over the intents that the query states, for candidates of their category: a gain if met, else a loss."""
    out = F.lit(0.0)
    for word, of, pattern, gain, loss in INTENTS:
        asked = F.lower(query).contains(word) & (category == of)
        out = out + F.when(asked, F.when(F.lower(text).rlike(pattern), gain).otherwise(loss)).otherwise(0.0)
    return out
