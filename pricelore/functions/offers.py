"""Columns of offers' texts: prices in text, kinds of product, title quality, promotion noise, pictures, empty pages, failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelore.functions.text import ladder

# Patterns of lower-cased price texts.
PRICE = r"([0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]{1,2})?|[0-9]{3,7}(?:\.[0-9]{1,2})?)"
PRICE_NOISE = r"\bemi\b|/\s*month|per\s+month|monthly|\bcashback\b|\bexchange\b|\bcoupon\b|\bbank\s+offer\b|\bdelivery\b|\bwarranty\b|\bstarting\s+(?:at|from)\b"
ENTITIES = (("&#8377;", "₹"), ("\\u20b9", "₹"), ("&nbsp;", " "), ("&amp;", "&"), ("\\u002f", "/"), ("\\/", "/"))
# Least and largest price of each category, and of others.
PRICE_BOUNDS = {
    "camera": (3_000, 2_000_000), "headphones": (500, 150_000), "laptop": (5_000, 600_000), "refrigerator": (8_000, 500_000), "smartphone": (2_000, 250_000),
    "television": (5_000, 1_500_000), "tws": (500, 80_000), "washing_machine": (5_000, 250_000),
}
OTHER_BOUNDS = (100, 2_000_000)
# Forms of television models.
TV_SERIES = r"^(?:QA|QN|UE|Q)(?:[0-9]{2})?(LS[0-9]{2}[A-Z]|QN[0-9]{2}[A-Z]|Q[0-9][A-Z][0-9][A-Z]?)"
TV_SIZE, TV_BARE = r"^([0-9]{2})([A-Z]{1,3}[0-9]{1,4}[A-Z0-9]{0,6})$", "^[0-9]{2}[A-Z]"
# Words of accessories and kinds of camera, by lower-cased title.
CAMERA_ACCESSORY = r"\b(silicone?\s+(?:cover|case)|protective\s+(?:cover|case)|(?:camera\s+)?(?:case|cover|bag|strap|tripod|gimbal|filter|lens\s+cap|battery(?:\s+grip)?|charger|memory\s+card|sd\s+card|cage|mount|cleaning\s+kit))\b"
CAMERA_NAMED = r"\b(mirrorless\s+camera|dslr\s+camera|camera\s+with|earbuds?|headphones?|tws|buds)\b"
CAMERA_CUE = r"\b(canon|sony|nikon|fujifilm|eos|alpha|mirrorless|dslr)\b"
CAMERA_KIT = r"\b(kit|with\s+[0-9]{2,3}\s*[-–]\s*[0-9]{2,3}\s*mm|18-55|18-45|18-150|rf-s)\b"
CAMERA_BODY, CAMERA_WHOLE = r"\b(body\s+only|body\b|mirrorless|dslr)\b", r"\b(camera|body|kit)\b"
CAMERA_LENS = r"\b(lens\s+only|prime\s+lens|zoom\s+lens|telephoto\s+lens|ef-s|rf-s\s*[0-9])\b"
PHONE_ACCESSORY = r"\b(case|cover|tempered\s+glass|screen\s+(?:guard|protector)|charger|cable|holder|back\s+cover)\b"
AUDIO_ACCESSORY = r"\b(replacement\s+(?:case|ear\s*tips?)|ear\s*tips?|charging\s+case|ear\s*(?:cushions?|pads?)|headphone\s+(?:cable|cord|stand)|sound\s*bars?|home\s+theat(?:re|er)|silicone?\s+(?:case|cover)|(?:case|cover)\s+(?:for|compatible\s+with)\s+(?:galaxy\s+buds|airpods|buds|wf-)|earbuds?\s+for\s+(?:samsung|apple|oneplus|galaxy)|protective\s+(?:case|cover)\s+for)\b"
TV_ACCESSORY = r"\b(remote|wall\s+mount|tv\s+stand|tv\s+unit)\b"
APPLIANCE_ACCESSORY = r"\b((?:fridge|refrigerator|washing[\s-]*machine)\s+(?:stand|cover|base|trolley|mat))\b"
COMPATIBLE = ("product camera_body", "product camera_kit", "product unknown", "unknown camera_body", "unknown camera_kit")
# Words of titles that are lists of features, and words of shops that titles don't need.
BULLETS = (
    "mp camera", "mah battery", "amoled", "ips display", "free shipping", "warranty", "cash on delivery", "bank offer", "exchange offer", "emi from",
    "suitable for:", "slow motion", "oversampling", "frames per second", "dual pixel", "collaborative is",
)
FEATURES, FEATURE_FIRST = r"^(?:[^,]{2,40},\s*){3,}[^,]{2,80}$", r"^[0-9]+\s*(mp|mah|gb|tb|hz|fps)\b"
TITLE_BRANDS = (
    "apple", "samsung", "oneplus", "xiaomi", "redmi", "realme", "vivo", "oppo", "google", "pixel", "sony", "canon", "nikon", "lg", "dell", "hp",
    "lenovo", "asus", "acer", "msi", "nothing", "motorola", "moto", "jbl", "boat", "noise", "croma", "nokia", "honor", "iqoo", "poco",
)
KNOWN_BRAND = r"\b(samsung|apple|iphone|oneplus|xiaomi|redmi|realme|vivo|oppo|google|pixel|sony|canon|nikon|lg|dell|hp|lenovo|asus|acer|msi|nothing|motorola|moto|jbl|boat|noise|croma)\b"
SHOP_WORDS = r"online\s+at\s+best\s+price(?:\s+on\s+[\w.]+)?|best\s+price\s+on\s+[\w.]+|buy\s+online|shop\s+online|free\s+delivery|with\s+offers?|emi\s+available|exchange\s+available|lowest\s+price|flipkart\.com|amazon\.in|croma\.com"
SHOP_TAIL = rf"(?i)(?:[\s|\-–—:]+(?:{SHOP_WORDS})\.?)+[\s|\-–—:]*$"
SHOP_INLINE = r"(?i)\s*\((?:buy\s+online|best\s+price|with\s+offer[^)]*)\)\s*"
PROMOTIONS = (
    r"best\s+seller", "bestseller", r"new\s+launch", r"newly\s+launched", r"no\s+cost\s+emi", r"zero\s+cost\s+emi", r"\bemi\b", r"bank\s+offer",
    r"bank\s+discount", r"instant\s+discount", r"exchange\s+offer", r"exchange\s+bonus", r"free\s+delivery", r"free\s+shipping", r"limited\s+offer",
    r"limited\s+time", r"special\s+price", r"deal\s+of\s+the\s+day", r"today'?s\s+deal", r"with\s+alexa", r"works?\s+with\s+alexa",
    r"google\s+assistant", r"smart\s+features?", r"inclusive\s+of\s+all\s+taxes", r"including\s+gst", r"[0-9]+\s*%\s*off", r"upto\s+[0-9]+\s*%",
    r"save\s+₹?\s*[0-9,]+", r"emi\s+(?:starts?|from)\s+₹?\s*[0-9,]+", r"₹?\s*[0-9,]+\s*/\s*month", r"per\s+month",
)
PROMOTION = rf"(?i)(?:^|\s)(?:{'|'.join(PROMOTIONS)})(?:\s|$)"
# What tells phones from other things.
NOT_PHONE = r"\b(tablet|ipad|galaxy\s*tab\b|smart\s*watch|galaxy\s*watch|watch[0-9]|feature\s*phone|dongle|hotspot|mifi|data\s*card|case|cover|tempered|screen\s*guard|charger|cable|power\s*bank|earbuds?|headphones?|buds\b|monitor|laptop|notebook|display\s+only|replacement\s+display)\b"
PHONE_BRAND = r"\b(apple|iphone|samsung|galaxy|oneplus|google|pixel|xiaomi|redmi|poco|realme|motorola|moto|nothing|vivo|oppo|iqoo|infinix|tecno|lava|nokia)\b"
PHONE_SHAPE, PHONE_NAMED = r"\b([0-9]+\s*gb|5g)\b", r"\b(iphone|smartphone|mobile phone)\b"
FRAGMENT = r"^(response time|exposure mode|refresh rate|[0-9]+(\.[0-9]+)?\s*cm\s*\(|[0-9]+\s*gb ram\b|[0-9]+\s*mah\b|battery)"
# Pictures that show no product, and parts of addresses that only size a picture.
BAD_PICTURE = r"(?i)(1x1|pixel|spacer|logo|banner|placeholder|tracking|sprite|badge|icon[_-]?only)"
PICTURE = r"(?i)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"
THUMBS, SIZE_SUFFIX = r"/(?:128|200|312|416|832)(?:/(?:128|200|312|416|832))?/", r"(?i)\._[A-Z0-9_,]+_\."
SIZES_A, SIZES_B = ("q", "quality", "w", "h", "width", "height", "crop"), ("w", "h", "width", "height", "auto")
# Words of pages that are blocked or empty, and of failures.
PAGE_RULES = [
    (r"captcha|robot check|verify you are human|unusual traffic|access denied|cf-challenge", "captcha_or_bot_check"),
    (r"no results|0 results|did not match any products|sorry, no results", "empty_result_page"),
]
TIMEOUT, NETWORK, PARSE = "timeout|timed out|timeouterror", "connect|connection|network|dns|proxy|ssl", "parse|json|selector|beautifulsoup|lxml"
LOGIN, EMPTY = "login|sign-in|signin|authentication", "empty|no products|no listings"


def low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def trimmed(text: Column) -> Column:
    """Single blanks, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def price_in_text(text: Column, least: Column | int = 100, largest: Column | int = 2_000_000) -> Column:
    """The price of the first segment; null where that segment speaks of instalments, offers or delivery, or outside the bounds."""
    plain = low(text)
    for old, new in ENTITIES:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    first = F.get(F.split(plain, r"[\n|;]+"), F.lit(0))
    own, any_ = F.regexp_extract(first, PRICE, 1), F.regexp_extract(plain, PRICE, 1)
    raw = F.when(own != "", own).when(~plain.rlike(PRICE_NOISE), F.when(any_ != "", any_).otherwise(F.regexp_replace(plain, "[^0-9]", "")))
    digits = F.regexp_replace(F.regexp_replace(raw, r"\.[0-9]{1,2}$", ""), "[^0-9]", "")
    value = F.when(F.length(digits).between(1, 18), digits.cast("long"))
    return F.when(~first.rlike(PRICE_NOISE) & value.between(least, largest), value)


def bounds(category: Column) -> tuple[Column, Column]:
    """Least and largest price of a category; a null one counts as laptops."""
    out = []
    for i in (0, 1):
        rule = F.when(category.isNull(), PRICE_BOUNDS["laptop"][i])
        for name, pair in PRICE_BOUNDS.items():
            rule = rule.when(category == name, pair[i])
        out.append(rule.otherwise(OTHER_BOUNDS[i]))
    return out[0], out[1]


def in_bounds(price: Column, category: Column) -> Column:
    """Whether a price is one of its category."""
    rule = F.when(F.lit(False), F.lit(False))
    for name, (least, largest) in PRICE_BOUNDS.items():
        rule = rule.when(category == name, price.between(least, largest))
    return F.coalesce(rule.otherwise(price.between(*OTHER_BOUNDS)), F.lit(False))


def tv_aliases(codes: Column) -> Column:
    """Different codes, with the series in a full code and the code without its size, in their order."""
    clean = F.filter(F.transform(codes, lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")), lambda c: c != "")
    series = lambda c: F.regexp_extract(c, TV_SERIES, 1)
    size, rest = (lambda c: F.regexp_extract(c, TV_SIZE, 1).try_cast("int")), (lambda c: F.regexp_extract(c, TV_SIZE, 2))
    more = lambda c: F.array(c, F.when(F.length(series(c)) >= 4, series(c)), F.when(size(c).between(24, 98) & (F.length(rest(c)) >= 3), rest(c)))
    return F.array_distinct(F.filter(F.flatten(F.transform(clean, more)), lambda c: c.isNotNull()))


def tv_key(codes: Column) -> Column:
    """The shortest alias, then the first in order; those that start with a size only where there are no others."""
    aliases = tv_aliases(codes)
    bare = F.filter(aliases, lambda c: ~c.rlike(TV_BARE))
    pool = F.when(F.size(bare) > 0, bare).otherwise(aliases)
    return F.substring(F.array_min(F.transform(pool, lambda c: F.concat(F.lpad(F.length(c).cast("string"), 4, "0"), c))), 5, 10_000)


def product_type(title: Column, category: Column) -> Column:
    """accessory kinds, camera_body, camera_kit, camera_lens or product."""
    t, c = low(title), low(category)
    camera = (c == "camera") | (c.isin("", "unknown", "accessory") & t.rlike(CAMERA_CUE))
    return (
        F.when(t.rlike(APPLIANCE_ACCESSORY), "appliance_accessory").when(c.isin("tws", "headphones") & t.rlike(AUDIO_ACCESSORY), "audio_accessory")
        .when((c == "television") & t.rlike(TV_ACCESSORY), "tv_accessory").when((c == "smartphone") & t.rlike(PHONE_ACCESSORY), "phone_accessory")
        .when(camera & t.rlike(CAMERA_ACCESSORY) & ~t.rlike(CAMERA_NAMED), "camera_accessory").when(camera & t.rlike(CAMERA_LENS) & ~t.rlike(CAMERA_WHOLE), "camera_lens")
        .when(camera & t.rlike(CAMERA_KIT), "camera_kit").when(camera & t.rlike(CAMERA_BODY), "camera_body").when(c == "accessory", "accessory").otherwise("product")
    )


def types_compatible(a: Column, b: Column) -> Column:
    both = lambda x, y: F.concat_ws(" ", x, y)
    return (a == b) | both(a, b).isin(*COMPATIBLE) | both(b, a).isin(*COMPATIBLE)


def is_feature_list(title: Column) -> Column:
    """A title that names features, or a brand alone, in place of a product."""
    text = trimmed(title)
    t, commas = F.lower(text), F.size(F.split(text, ",")) - 1
    words = F.regexp_extract_all(t, F.lit("([a-z0-9]+)"))
    markers = sum((t.contains(m).cast("int") for m in BULLETS), F.lit(0))
    brand_only = (F.size(words) <= 2) & (F.size(F.array_except(words, F.array(*map(F.lit, TITLE_BRANDS)))) == 0)
    return (F.length(text) < 8) | brand_only | ((commas >= 3) & text.rlike(FEATURES)) | (commas >= 4) | t.rlike(FEATURE_FIRST) | (markers >= 2) | ((commas >= 1) & ~t.rlike(KNOWN_BRAND) & ((commas >= 2) | text.contains("&")))


def without_shop_words(title: Column) -> Column:
    """A title without a shop's words in brackets and, however many, at its end; null if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(trimmed(title), SHOP_INLINE, " "), SHOP_TAIL, "")
    text = F.regexp_replace(text, r"^[\s|\-–—:]+|[\s|\-–—:]+$", "")
    return F.when(text != "", text)


def public_title(title: Column) -> Column:
    """without_shop_words, up to a blank within 280 characters; null for lists of features."""
    text = without_shop_words(title)
    short = F.when(F.length(text) > 280, F.trim(F.regexp_replace(F.substring(text, 1, 280), " [^ ]*$", ""))).otherwise(text)
    return F.when(~is_feature_list(text), short)


def without_promotions(title: Column) -> Column:
    """A title without promotion phrases that stand between blanks."""
    return trimmed(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), PROMOTION, " "))


def phone_verdict(title: Column) -> Column:
    """fragment, wrong_category, correct_smartphone or ambiguous."""
    t = F.trim(low(title))
    named = (t.rlike(PHONE_BRAND) & t.rlike(PHONE_SHAPE)) | t.rlike(PHONE_NAMED)
    return F.when((t == "") | t.rlike(FRAGMENT), "fragment").when(t.rlike(NOT_PHONE), "wrong_category").when(named, "correct_smartphone").otherwise("ambiguous")


def picture_url(url: Column) -> Column:
    """A picture's address without what only sizes it; null for addresses that show no product."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    raw = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw)
    part = lambda i: F.regexp_extract(raw, PICTURE, i)
    host, path = F.lower(part(2)), part(3)
    without = lambda names: F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*names)), "&")
    a, b, c = host.rlike(r"flixcart\.com|flipkart"), host.contains("amazon"), host.rlike("reliancedigital|jiomart")
    path = F.when(a, F.regexp_replace(path, THUMBS, "/")).when(~a & b, F.regexp_replace(path, SIZE_SUFFIX, ".")).otherwise(path)
    query = F.when(a, without(SIZES_A)).when(b, "").when(c, without(SIZES_B)).otherwise(part(4))
    clean = F.concat(F.lower(part(1)), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((part(1) != "") & ~F.lower(raw).contains("javascript:") & ~clean.rlike(BAD_PICTURE), clean)


def picture_key(url: Column) -> Column:
    return F.sha2(F.coalesce(picture_url(url), F.trim(F.coalesce(url, F.lit("")))), 256)


def empty_page_kind(html: Column) -> Column:
    """Why a page gave no products."""
    return ladder(low(html), PAGE_RULES, "selector_or_content_failure")


def failure_class(status: Column, warnings: Column, price: Column, error: Column) -> Column:
    """A bounded class of a refresh that failed, by its page's status, warnings, price and exception text (null: none)."""
    s, w, e = F.trim(low(status)), low(warnings), low(error)
    thrown = F.when(e.rlike(TIMEOUT), "timeout").when(e.rlike(NETWORK), "network").when(e.rlike(PARSE), "parsing").when(e.rlike(LOGIN), "login_required").when(e.contains("circuit"), "blocked").otherwise("unknown")
    no_price = F.when(w.rlike(PARSE), "parsing").when(w.rlike(EMPTY) | s.isin("", "unknown"), "empty").otherwise("invalid_price")
    return (
        F.when(s.isin("blocked", "captcha"), "challenge").when(s == "not_found", "unavailable").when(w.rlike(LOGIN), "login_required")
        .when((s == "failed") & w.rlike(TIMEOUT), "timeout").when(s.isin("failed", "unknown") & w.rlike(NETWORK), "network")
        .when(price.isNull() & s.isin("success", "partial", "unknown", ""), no_price).when(error.isNotNull(), thrown).when(s == "partial", "empty").otherwise("unknown")
    )
