"""Specifications that titles of phones, refrigerators and washing machines name, and what makes two of them different products.

Each category has a list of Spec (a column by a pattern) and of Axis (a column in which two products conflict); SQL is made of
the same lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelore.functions import specs


@dataclass(frozen=True)
class Spec:
    """A column: group of the first match of pattern in the folded title, as double, int, text (runs of blanks made one) or joined (with _)."""

    name: str
    pattern: str
    kind: str
    group: int = 1


@dataclass(frozen=True)
class Axis:
    """Two products conflict in a column if both have it, and it differs by more than the tolerance."""

    name: str
    tolerance: float | None = None


# Patterns of specifications in lower-cased titles, and the columns that set two products apart.
STAR = Spec("star_rating", r"\b([1-5])\s*star\b", "int")
PHONE_RAM = (4, 6, 8, 12, 16, 18, 24)
PHONE_CODE = r"\b(?:sm-[a-z0-9]{4,10}|cph[0-9]{4,5}|rmx[0-9]{4}|mzb[0-9]{4,}[a-z0-9]*|m[0-9]{4}[a-z0-9]{2,6}|xq-[a-z0-9]{4,8}|a[0-9]{4}|ge[0-9]{4}|le[0-9]{4}|in[0-9]{4})\b"
TWO_DRUMS = r"\b([0-9]{1,2}(?:\.[0-9])?)\s*(?:kg)?\s*[-/]\s*([0-9]{1,2}(?:\.[0-9])?)\s*kg\b"
SPECS: dict[str, tuple[Spec, ...]] = {
    "smartphone": (
        Spec("display_size_inch", r"\b([0-9]{1,2}(?:\.[0-9])?)\s*(?:\x22|\x27\x27|inch|inches|in)\b", "double"),
        Spec("chipset", r"\b(snapdragon\s*[0-9]{3,4}[a-z]?|dimensity\s*[0-9]{3,4}|helio\s*[a-z]?[0-9]{2,4}|exynos\s*[0-9]{4}|tensor\s*[a-z]?[0-9]?|a1[5-9]\s*bionic|a1[5-9]|bionic|kirin\s*[0-9]{3,4})\b", "text"),
        Spec("network_generation", r"\b(5g|4g|lte)\b", "text"),
        Spec("family", (
            r"\b(galaxy\s+[a-z][0-9]{1,2}(?:\s*(?:fe|plus|\+|ultra|5g))?|iphone\s*(?:[0-9]{1,2}|se|x[rs]?)(?:\s*(?:pro(?:\s*max)?|plus|mini))?|pixel\s*[0-9]{1,2}(?:\s*(?:pro|a|xl))?|"
            r"redmi\s*(?:note\s*)?[0-9]{1,2}(?:\s*(?:pro|plus|\+|5g))?|poco\s*[a-z]?[0-9]{1,2}(?:\s*(?:pro|5g))?|oneplus\s*(?:nord\s*(?:ce\s*)?)?[0-9]*(?:\s*(?:lite|pro|5g))?|"
            r"nord\s*(?:ce\s*)?[0-9]*(?:\s*(?:lite|5g))?|nothing\s*phone\s*\(?[0-9]\)?|moto\s*[a-z]?[0-9]+)\b"), "joined"),
        Spec("color", (
            r"\b(black|white|silver|gold|blue|red|green|pink|purple|grey|gray|titanium|natural|desert|ultramarine|teal|midnight|starlight|graphite|burgundy|glacier|cosmic\s*orange|"
            r"orange|yellow|violet|lavender|mint|cream|beige|space\s*black|space\s*grey|space\s*gray|phantom\s*black|deep\s*purple)\b"), "text"),
    ),
    "refrigerator": (
        Spec("capacity_l", r"\b([0-9]{2,4}(?:\.[0-9])?)\s*(?:l|ltr|litre|litres|liter|liters)\b", "double"),
        Spec("door_type", r"\b(single[\s-]?door|double[\s-]?door|triple[\s-]?door|multi[\s-]?door|side[\s-]?by[\s-]?side|french[\s-]?door)\b", "joined"),
        STAR, Spec("frost_type", r"\b(frost[\s-]?free|direct[\s-]?cool)\b", "joined"), Spec("compressor_type", r"\b(inverter|non[\s-]?inverter|digital\s*inverter)\b", "joined"),
    ),
    "washing_machine": (
        Spec("one_drum_kg", r"\b([0-9]{1,2}(?:\.[0-9])?)\s*kg\b", "double"), Spec("wash_kg", TWO_DRUMS, "double"), Spec("dry_capacity_kg", TWO_DRUMS, "double", 2),
        Spec("load_type", r"\b(front[\s-]?load|top[\s-]?load)(?:ing)?\b", "joined"), Spec("automation_type", r"\b(fully\s*automatic|semi[\s-]?automatic|automatic)\b", "joined"),
        STAR, Spec("rpm", r"\b([0-9]{3,4})\s*rpm\b", "int"), Spec("inverter", r"\b(inverter|digital\s*inverter)\b", "joined"),
    ),
}
AXES: dict[str, tuple[Axis, ...]] = {
    "smartphone": (Axis("ram_gb", 0.0), Axis("storage_gb", 0.0), Axis("color")), "refrigerator": (Axis("capacity_l", 5.0), Axis("door_type")),
    "washing_machine": (Axis("capacity_kg", 0.25), Axis("load_type"), Axis("automation_type")),
}
#: The columns of columns() by category, brand and model_codes apart.
NAMES = {
    "smartphone": ("family", "ram_gb", "storage_gb", "chipset", "display_size_inch", "network_generation", "color"), "refrigerator": ("capacity_l", "door_type", "star_rating", "frost_type", "compressor_type"),
    "washing_machine": ("family", "capacity_kg", "dry_capacity_kg", "load_type", "automation_type", "star_rating", "rpm", "inverter"),
}


def value(low: Column, spec: Spec) -> Column:
    found = specs.none_if(F.trim(F.regexp_extract(low, spec.pattern, spec.group)))
    if spec.kind == "double":
        return F.round(found.cast("double"), 1)
    return found.cast("int") if spec.kind == "int" else F.regexp_replace(found, r"[\s-]+" if spec.kind == "joined" else r"\s+", "_" if spec.kind == "joined" else " ")


def model_codes(title: Column, category: str) -> Column:
    """Sorted codes of five characters or more; of phones also the normal codes of their makers' forms."""
    raw = specs.raw_codes(title)
    codes = F.filter(raw, lambda c: F.length(c) >= 5)
    if category == "smartphone":
        forms = F.transform(F.regexp_extract_all(specs.folded(title), F.lit(PHONE_CODE), F.lit(0)), F.upper)
        codes = F.concat(codes, F.filter(F.transform(F.concat(raw, forms), specs.normal_code), lambda c: c.isNotNull()))
    return F.array_sort(F.array_distinct(codes))


def columns(title: Column, category: str) -> dict[str, Column]:
    """brand, model_codes and NAMES[category] of titles of one category; null where a title doesn't name them.

    A machine with two drums has the washing one's capacity; its family is the brand with the way of loading.
    """
    found = {s.name: value(specs.folded(title), s) for s in SPECS[category]}
    found |= {"brand": specs.brand(title), "model_codes": model_codes(title, category)}
    if category == "smartphone":
        found |= {"ram_gb": specs.ram_gb(title, PHONE_RAM), "storage_gb": specs.storage_gb(title, PHONE_RAM)}
    if category == "washing_machine":
        found["capacity_kg"] = F.coalesce(found["wash_kg"], found["one_drum_kg"])
        found["family"] = F.concat(found["brand"], F.lit("_"), F.coalesce(found["load_type"], F.lit("washer")))
    return {name: found[name] for name in ("brand", "model_codes", *NAMES[category])}


def hard_conflicts(a: Column, b: Column, category: str) -> Column:
    """The names of the axes in which two structs of columns() conflict, model_code first; unknown values never do."""
    shared = (F.size(a["model_codes"]) > 0) & (F.size(b["model_codes"]) > 0) & ~F.arrays_overlap(a["model_codes"], b["model_codes"])
    rules = [F.when(shared, "model_code")]
    for axis in AXES[category]:
        x, y = a[axis.name], b[axis.name]
        rules.append(F.when(x != y if axis.tolerance is None else F.abs(x - y) > axis.tolerance, axis.name))
    return F.filter(F.array(*rules), lambda c: c.isNotNull())


def sql_columns(title: str, category: str) -> str:
    """columns() as DuckDB SQL over a column with the brand (`brand`) and all raw codes (`raw_codes`)."""
    quoted = [x.replace("'", "''") for x in (specs.ACCENTS, specs.PLAIN)]
    low = f"translate(lower(coalesce({title}, '')), '{quoted[0]}', '{quoted[1]}')"
    found = {}
    for s in SPECS[category]:
        text = f"nullif(trim(regexp_extract({low}, '{s.pattern}', {s.group})), '')"
        found[s.name] = {
            "double": f"round(CAST({text} AS DOUBLE), 1)", "int": f"CAST({text} AS INTEGER)",
            "joined": f"regexp_replace({text}, '[\\s-]+', '_', 'g')", "text": f"regexp_replace({text}, '\\s+', ' ', 'g')",
        }[s.kind]
    codes = "list_filter(raw_codes, lambda c: length(c) >= 5)"
    if category == "smartphone":
        forms = f"list_transform(regexp_extract_all({low}, '{PHONE_CODE}'), lambda c: upper(c))"
        normal = f"list_filter(list_transform(list_concat(raw_codes, {forms}), lambda c: {specs.sql_normal_code('c')}), lambda c: c IS NOT NULL)"
        codes = f"list_concat({codes}, {normal})"
        sizes = ", ".join(f"'{n}'" for n in PHONE_RAM)
        found["ram_gb"] = f"list_max(list_transform(list_filter(regexp_extract_all({low}, '{specs.RAM}', 1), lambda x: regexp_matches(x, 'gb$') AND regexp_extract(x, '^([0-9.]+)', 1) IN ({sizes})), lambda x: CAST(regexp_extract(x, '^([0-9.]+)', 1) AS INTEGER)))"
        number = "CAST(floor(CAST(regexp_extract(x, '^([0-9.]+)', 1) AS DOUBLE) * CASE WHEN regexp_matches(x, 'tb$') THEN 1024 ELSE 1 END) AS INTEGER)"
        found["storage_gb"] = f"list_max(list_filter(list_transform(regexp_extract_all({low}, '{specs.STORAGE}', 1), lambda x: {number}), lambda x: x >= 32 AND x <> coalesce({found['ram_gb']}, -1)))"
    if category == "washing_machine":
        found["capacity_kg"] = f"coalesce({found['wash_kg']}, {found['one_drum_kg']})"
        found["family"] = f"brand || '_' || coalesce({found['load_type']}, 'washer')"
    return ", ".join([f"list_sort(list_distinct({codes})) AS model_codes", *(f"{found[name]} AS {name}" for name in NAMES[category])])


def sql_hard_conflicts(a: str, b: str, category: str) -> str:
    rules = [f"CASE WHEN len({a}.model_codes) > 0 AND len({b}.model_codes) > 0 AND len(list_intersect({a}.model_codes, {b}.model_codes)) = 0 THEN 'model_code' END"]
    for axis in AXES[category]:
        x, y = f"{a}.{axis.name}", f"{b}.{axis.name}"
        rules.append(f"CASE WHEN {f'{x} <> {y}' if axis.tolerance is None else f'abs({x} - {y}) > {axis.tolerance}'} THEN '{axis.name}' END")
    return f"concat_ws(',', {', '.join(rules)})"
