"""Columns of product titles: brand, specifications of laptops, model codes, families; and the same as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelore.functions.text import foldings

#: Latin letters with accents.
ACCENTS, PLAIN = foldings(0x180)
# Brands in order of precedence, and product lines that tell a brand.
BRANDS = (
    "hp", "dell", "lenovo", "asus", "acer", "apple", "samsung", "msi", "lg", "microsoft", "toshiba", "razer", "gigabyte", "huawei", "honor",
    "infinix", "avita", "ultimus", "thomson", "chuwi", "walker", "browsebook", "realme", "xiaomi", "redmi", "oneplus", "motorola", "vaio", "jio",
    "jiobook", "primebook", "zebronics", "wings", "iball", "sony", "vivo", "oppo", "nothing", "google", "boat", "noise", "jbl", "bose",
    "sennheiser", "whirlpool", "godrej", "haier", "bosch", "ifb", "voltas", "tcl", "hisense", "panasonic", "canon", "nikon", "fujifilm", "poco",
    "iqoo", "nokia", "lava", "micromax", "blue star", "carrier", "daikin",
)
LINES = {
    "hewlett": "hp", "hewlett packard": "hp", "rog": "asus", "vivobook": "asus", "zenbook": "asus", "tuf": "asus", "proart": "asus",
    "expertbook": "asus", "ideapad": "lenovo", "thinkpad": "lenovo", "thinkbook": "lenovo", "loq": "lenovo", "legion": "lenovo", "yoga": "lenovo",
    "inspiron": "dell", "xps": "dell", "latitude": "dell", "vostro": "dell", "alienware": "dell", "pavilion": "hp", "omen": "hp", "victus": "hp",
    "envy": "hp", "elitebook": "hp", "omnibook": "hp", "spectre": "hp", "macbook": "apple", "galaxy": "samsung", "nitro": "acer",
    "aspire": "acer", "predator": "acer", "swift": "acer",
}
# Sizes of memory, and patterns of specifications in lower-cased titles.
RAM_SIZES = (4, 6, 8, 10, 12, 16, 18, 24, 32, 36, 48, 64, 96, 128)
RAM = r"(?:^|[^a-z0-9_.])([0-9.]+\s*gb(?:\s*(?:ssd|hdd|nvme|emmc|ufs|storage|rom|nand|m\.2)|\b))"
STORAGE = r"\b([0-9]{1,4}(?:\.[0-9]+)?\s*[gt]b)\b"
SCREEN = r"\b([0-9]{1,2}(?:\.[0-9]{1,2})?)\s*(?:inches|inch)\b|\b([0-9]{2}(?:\.[0-9]{1,2})?)\s*cm\b"
GENERATION = r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s*gen(?:eration)?\b"
GPU = r"\b(rtx\s*[0-9]{4}\s*(?:ti)?|gtx\s*[0-9]{3,4}\s*(?:ti)?|mx\s*[0-9]{3}|radeon\s*(?:[0-9]{3,4}m?|rx\s*[0-9]{3,4}m?)|iris\s*xe|uhd\s*graphics|arc\s*graphics)\b"
CPUS = (
    (r"\bcore\s*ultra\s*([0-9]+)\s*([0-9]{3}[a-z]?)?\b", "intel_core_ultra"),
    (r"\bcore\s*i([3579])[-\s]*([0-9]{4,5}[a-z]{0,3})?\b", "intel_core_i"),
    (r"\b(?:intel\s*)?core\s*([3579])(?:[-\s]+|\s*)([0-9]{3}[a-z]{0,3})?\b", "intel_core_new"),
    (r"\bceleron\s*(?:dual\s*core\s*)?(n?[0-9]{4}|n[0-9]{2})?\b", "intel_celeron"),
    (r"\bpentium\s*(?:quad\s*core\s*)?(n?[0-9]{4})?\b", "intel_pentium"),
    (r"\bathlon\s*(?:silver|gold)?\s*([0-9]{4}[a-z]?)?\b", "amd_athlon"),
    (r"\bryzen\s*(ai\s*)?([3579])\s*(?:pro\s*)?([0-9]{3,4}[a-z]{0,3})?\b", "amd_ryzen"),
    (r"\bsnapdragon\s*x\s*(elite|plus)?\b", "qualcomm_snapdragon_x"),
    (r"\bm\s*([1-5])\s*(pro|max|ultra)?\b", "apple_m"),
    (r"\ba([0-9]{1,2})\s*bionic\b", "apple_a"),
)
SKU = r"\b([0-9]{4,5}(?:hx|hk|hs|h|u|p|g[1-7]|y|e))\b"
CODE = r"\b(?:[a-z]{1,3}[0-9]{2,4}[a-z]{1,5}[0-9]{0,4}|[0-9]{2}[a-z]{1,5}[0-9]{1,4}[a-z]{0,3}|[a-z]{2,5}[0-9]{3,8}[a-z]{0,5}|[0-9]{2}-[a-z]{2}[0-9]{3,5}[a-z]{2}|[a-z]{1,3}[0-9]{4}[a-z]{2,4}-[a-z0-9]{3,8})\b"
CPU_CODE, WEAK_CODE = "^I[3579][0-9]{4,5}[A-Z]*$", "^[0-9]{2}[A-Z]{2,5}[0-9]{1,2}[A-Z]?$"
NO_CODES = ("WINDOWS11", "OFFICE2024")
JUNK_CODES = (
    "WIRED", "WIRELESS", "BLUETOOTH", "BLACK", "WHITE", "CAMERA", "SMART", "ANDROID", "IPHONE", "GALAXY", "LAPTOP", "TABLET", "PHONE", "MOBILE",
    "HDMI", "USB", "TYPEC", "ANC", "ACTIVE", "NOISE", "CANCEL", "PRO", "MAX", "PLUS", "MINI", "LITE", "ULTRA", "KIT", "BODY", "ONLY", "5G", "4G",
    "LTE", "AMOLED", "OLED", "LED", "QLED", "FPS", "UHD", "FHD", "RAW",
)
FAMILIES = (
    r"(ideapad\s+slim\s*[0-9]+|ideapad\s*[0-9]+|thinkpad\s+[a-z][0-9]+|thinkbook\s+[0-9]+|loq\s+[0-9]+|legion\s+[0-9]+|yoga\s+slim\s*[0-9]+|yoga\s+[0-9]+)",
    r"(vivobook\s*(?:go\s*)?[0-9]+|expertbook\s*p[0-9]+|zenbook\s*(?:duo\s*)?[0-9]+|proart\s+\w+|rog\s+\w+|tuf\s*(?:gaming\s*)?[af][0-9]+)",
    r"(inspiron\s+[0-9]+|xps\s+[0-9]+|latitude\s+[0-9]+|vostro\s+[0-9]+|alienware\s+\w+|dc\s*[0-9]{5})",
    r"(pavilion\s*(?:plus\s*)?[0-9]+|omen\s+[0-9]+|victus\s+[0-9]+|envy\s+[0-9]+|elitebook\s+[0-9]+|omnibook\s+[0-9]+|spectre\s+\w+)",
    r"(aspire\s*(?:lite\s*)?[0-9]*|nitro\s*(?:v\s*)?[0-9]+|predator\s+\w+|swift\s*(?:go\s*)?\w+)",
    r"(macbook\s+(?:air|pro)\s*(?:m[0-9])?)", r"(galaxy\s+book\s*[0-9]+)", r"(surface\s+(?:pro|laptop|book)\s*[0-9]*)", r"(jiobook\s*[0-9]*)",
)
FAMILY_WORDS = (
    "ideapad", "thinkpad", "thinkbook", "loq", "legion", "yoga", "vivobook", "zenbook", "tuf", "inspiron", "pavilion", "omen", "victus", "envy",
    "aspire", "nitro", "predator", "swift", "macbook",
)
UNIT = r"\s*(?:\.[0-9]+\s*)?(?:gb|tb|inch|inches|cm)\b"

LINES_LONGEST_FIRST = tuple(sorted(LINES, key=lambda k: -len(k)))


def folded(title: Column) -> Column:
    return F.translate(F.lower(F.coalesce(title, F.lit(""))), ACCENTS, PLAIN)


def none_if(text: Column, value: str = "") -> Column:
    return F.when(text != value, text)


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def groups(pattern: str) -> int:
    return re.compile(pattern).groups


def brand(title: Column) -> Column:
    """The brand of the longest product line named in a title, else of the first of BRANDS that is; null if none is."""
    low = folded(title)
    tokens = F.split(low, r"[^a-z0-9_]+")
    for two in ("hewlett packard", "blue star"):
        tokens = F.concat(tokens, F.when(low.rlike(rf"\b{two}\b"), strings((two,))).otherwise(F.array().cast("array<string>")))
    line = F.get(F.array_intersect(strings(LINES_LONGEST_FIRST), tokens), F.lit(0))
    of = F.create_map(*(F.lit(x) for pair in LINES.items() for x in pair))
    return F.coalesce(of[line], F.get(F.array_intersect(strings(BRANDS), tokens), F.lit(0)))


def ram_gb(title: Column, sizes: tuple[int, ...] = RAM_SIZES) -> Column:
    """The largest size of memory named, GB with nothing of storage after it."""
    hits = F.transform(F.filter(F.regexp_extract_all(folded(title), F.lit(RAM)), lambda x: x.rlike("gb$")), lambda x: F.regexp_extract(x, "^([0-9.]+)", 1))
    known = F.filter(hits, lambda x: x.isin([str(n) for n in sizes]))
    return F.array_max(F.transform(known, lambda x: x.cast("int")))


def storage_gb(title: Column, ram_sizes: tuple[int, ...] = RAM_SIZES) -> Column:
    """The largest size of 32 GB or more that isn't the memory's."""
    number = lambda x: F.regexp_extract(x, r"^([0-9.]+)", 1).cast("double")
    sizes = F.transform(F.regexp_extract_all(folded(title), F.lit(STORAGE)), lambda x: F.floor(F.when(x.rlike("tb$"), number(x) * 1024).otherwise(number(x))).cast("int"))
    return F.array_max(F.filter(sizes, lambda x: (x >= 32) & (x != F.coalesce(ram_gb(title, ram_sizes), F.lit(-1)))))


def screen_inch(title: Column) -> Column:
    low = folded(title)
    inch, cm = (none_if(F.regexp_extract(low, SCREEN, i)).cast("double") for i in (1, 2))
    return F.round(F.coalesce(inch, cm / 2.54), 1)


def generation(title: Column) -> Column:
    return none_if(F.regexp_extract(folded(title), GENERATION, 1)).cast("int")


def gpu(title: Column) -> Column:
    return none_if(F.regexp_replace(F.regexp_extract(folded(title), GPU, 1), r"\s+", ""))


def cpu(title: Column) -> Column:
    """label[:series[:model]] of the first kind of processor named; a single model number named elsewhere is added."""
    low, found = folded(title), None
    for pattern, label in CPUS:
        name = F.concat_ws(":", F.lit(label), *(none_if(F.trim(F.regexp_extract(low, pattern, i))) for i in range(1, groups(pattern) + 1)))
        found = F.when(low.rlike(pattern), name) if found is None else found.when(low.rlike(pattern), name)
    models = F.array_distinct(F.regexp_extract_all(low, F.lit(SKU)))
    return F.when(~found.rlike("[0-9]{4,5}[a-z]") & (F.size(models) == 1), F.concat_ws(":", found, F.get(models, F.lit(0)))).otherwise(found)


def raw_codes(title: Column) -> Column:
    """All strings of the form of a model code, in their order."""
    return F.transform(F.regexp_extract_all(folded(title), F.lit(CODE), F.lit(0)), F.upper)


def model_codes(title: Column) -> Column:
    """Sorted model codes of five characters or more; none that name a processor or software."""
    return F.array_sort(F.array_distinct(F.filter(raw_codes(title), lambda c: (F.length(c) >= 5) & ~c.rlike(CPU_CODE) & ~c.isin(*NO_CODES))))


def normal_code(code: Column) -> Column:
    """A model code in upper case without odd characters; null for junk, short ones, words, and numbers under six digits."""
    c = F.regexp_replace(F.regexp_replace(F.upper(code), r"[^A-Z0-9\-/]", ""), r"^[-/]+|[-/]+$", "")
    bad = (F.length(c) < 4) | c.isin(*JUNK_CODES) | c.rlike("^[A-Z]{1,7}$") | c.rlike("^[0-9]{1,5}$") | c.rlike("^MOB[A-Z0-9]{8,}$") | c.rlike("^[0-9]{1,3}FPS[0-9]?$")
    return F.when(~bad, c)


def family(title: Column) -> Column:
    """The product family, words joined by _; a number that goes on as a size isn't its own."""
    low, found = folded(title), []
    for pattern in FAMILIES:
        found.append(F.when(low.rlike(pattern) & ~low.rlike(pattern + UNIT), F.regexp_replace(F.trim(F.regexp_extract(low, pattern, 1)), r"\s+", "_")))
    words = F.array_intersect(strings(FAMILY_WORDS), F.split(low, r"[^a-z0-9_]+"))
    return F.coalesce(*found, F.get(words, F.lit(0)))


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_columns(title: str) -> str:
    """The columns brand, ram_gb, storage_gb, screen_inch, generation, gpu, cpu, model_codes, raw_codes and family as DuckDB SQL."""
    quoted = [x.replace("'", "''") for x in (ACCENTS, PLAIN)]
    low = f"translate(lower({title}), '{quoted[0]}', '{quoted[1]}')"
    tokens = f"regexp_split_to_array({low}, '[^a-z0-9_]+')"
    tokens = f"list_concat(list_concat({tokens}, CASE WHEN regexp_matches({low}, '\\bhewlett packard\\b') THEN ['hewlett packard'] ELSE [] END), CASE WHEN regexp_matches({low}, '\\bblue star\\b') THEN ['blue star'] ELSE [] END)"
    first = lambda values: f"list_filter({sql_list(values)}, lambda v: list_contains({tokens}, v))[1]"
    of = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LINES.items()) + "}"
    ram = f"list_max(list_transform(list_filter(regexp_extract_all({low}, '{RAM}', 1), lambda x: regexp_matches(x, 'gb$') AND regexp_extract(x, '^([0-9.]+)', 1) IN ({', '.join(repr(str(n)) for n in RAM_SIZES)})), lambda x: CAST(regexp_extract(x, '^([0-9.]+)', 1) AS INTEGER)))"
    sizes = f"list_transform(regexp_extract_all({low}, '{STORAGE}', 1), lambda x: CAST(floor(CAST(regexp_extract(x, '^([0-9.]+)', 1) AS DOUBLE) * CASE WHEN regexp_matches(x, 'tb$') THEN 1024 ELSE 1 END) AS INTEGER))"
    group = lambda pattern, i: f"nullif(trim(regexp_extract({low}, '{pattern}', {i})), '')"
    cpus = "CASE " + " ".join(f"WHEN regexp_matches({low}, '{p}') THEN concat_ws(':', '{label}', {', '.join(group(p, i) for i in range(1, groups(p) + 1))})" for p, label in CPUS) + " END"
    skus = f"list_distinct(regexp_extract_all({low}, '{SKU}', 1))"
    families = ", ".join(f"CASE WHEN regexp_matches({low}, '{p}') AND NOT regexp_matches({low}, '{p}{UNIT}') THEN regexp_replace(trim(regexp_extract({low}, '{p}', 1)), '\\s+', '_', 'g') END" for p in FAMILIES)
    codes = f"list_transform(regexp_extract_all({low}, '{CODE}'), lambda c: upper(c))"
    return f"""coalesce(map_extract({of}, {first(LINES_LONGEST_FIRST)})[1], {first(BRANDS)}) AS brand, {ram} AS ram_gb,
    list_max(list_filter({sizes}, lambda x: x >= 32 AND x <> coalesce({ram}, -1))) AS storage_gb,
    round(coalesce(CAST({group(SCREEN, 1)} AS DOUBLE), CAST({group(SCREEN, 2)} AS DOUBLE) / 2.54), 1) AS screen_inch, CAST({group(GENERATION, 1)} AS INTEGER) AS generation,
    nullif(regexp_replace(regexp_extract({low}, '{GPU}', 1), '\\s+', '', 'g'), '') AS gpu,
    CASE WHEN NOT regexp_matches({cpus}, '[0-9]{{4,5}}[a-z]') AND len({skus}) = 1 THEN concat_ws(':', {cpus}, {skus}[1]) ELSE {cpus} END AS cpu,
    list_sort(list_distinct(list_filter({codes}, lambda c: length(c) >= 5 AND NOT regexp_matches(c, '{CPU_CODE}') AND c NOT IN ('WINDOWS11', 'OFFICE2024')))) AS model_codes,
    {codes} AS raw_codes, coalesce({families}, {first(FAMILY_WORDS)}) AS family"""


def sql_normal_code(code: str) -> str:
    c = f"regexp_replace(regexp_replace(upper({code}), '[^A-Z0-9\\-/]', '', 'g'), '^[-/]+|[-/]+$', '', 'g')"
    bad = " OR ".join([f"length({c}) < 4", f"{c} IN ({', '.join(map(repr, JUNK_CODES))})", *(f"regexp_matches({c}, '{p}')" for p in ("^[A-Z]{1,7}$", "^[0-9]{1,5}$", "^MOB[A-Z0-9]{8,}$", "^[0-9]{1,3}FPS[0-9]?$"))])
    return f"CASE WHEN NOT ({bad}) THEN {c} END"
