"""Specifications as JSON: existence of keys, guards on kinds and lengths, merging, faceted filters, aggregates over paths."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that a filter may name, and texts that count as numbers.
FACET_KEY = r"[a-z][a-z0-9_]{0,40}"
NUMBER = r"^[0-9]+(\.[0-9]+)?$"
Value = str | bool | int | float | None
ENTRIES = "map<string,variant>"


def at(path: str) -> str:
    """$["a"]["b"] for a path a.b."""
    return "$" + "".join(f'["{key}"]' for key in path.split(".") if key)


def inside(json: Column, path: str = "") -> Column:
    """The value (VARIANT) at a path of a JSON text; null where there is none, or where the text doesn't parse."""
    return F.try_variant_get(F.try_parse_json(json), at(path), "variant")


def text_in(json: Column, path: str) -> Column:
    """The value at a path as text: strings without quotes, JSON's null as null."""
    return F.try_variant_get(F.try_parse_json(json), at(path), "string")


def entries(json: Column) -> Column:
    """An object's entries as a map of VARIANT; null for other kinds."""
    return F.try_variant_get(F.try_parse_json(json), "$", ENTRIES)


def has_key(json: Column, key: str) -> Column:
    """Whether an object has a key, a null value included; false for null texts and other kinds."""
    return F.coalesce(F.map_contains_key(entries(json), key), F.lit(False))


def has_any_key(json: Column, keys: Collection[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(entries(json)), F.array(*map(F.lit, keys))) if keys else F.lit(False), F.lit(False))


def kind(json: Column, path: str = "") -> Column:
    """object, array, string, number, boolean or null: what stands at a path; null where nothing does."""
    own = F.schema_of_variant(inside(json, path))
    rules = [("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null")]
    out = F.when(own.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number")
    for begin, name in rules:
        out = out.when(own.startswith(begin), name)
    return out


def length(json: Column, path: str = "") -> Column:
    """The number of an array's elements; null for other kinds."""
    return F.when(kind(json, path) == "array", F.size(F.try_variant_get(F.try_parse_json(json), at(path), "array<variant>")))


def merged(left: Column, right: Column) -> Column:
    """Two JSON texts in one: entries of both objects, the right one's winning; else the elements of both, other kinds counting as one.

    Null if one of the texts is null or doesn't parse.
    """
    a, b = entries(left), entries(right)
    mine = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    both = F.to_json(F.map_concat(mine, b))
    elements = lambda x: F.when(kind(x) == "array", F.try_variant_get(F.try_parse_json(x), "$", "array<variant>")).otherwise(F.array(inside(x)))
    lists = F.to_json(F.concat(elements(left), elements(right)))
    known = F.try_parse_json(left).isNotNull() & F.try_parse_json(right).isNotNull()
    return F.when(known, F.when((kind(left) == "object") & (kind(right) == "object"), both).otherwise(lists))


def optional(column: Column | str, value: Value) -> Column:
    """column = value, or true where no value is given."""
    return F.lit(True) if value is None else F.coalesce(F.col(column) == value if isinstance(column, str) else column == value, F.lit(False))


def facet_filter(filters: Mapping[str, Value | Collection[Value]], specs: str = "specs", brand: str = "brand") -> Column:
    """A condition from a filter given at run time: all facets, and of a facet's values any.

    Booleans match true and false, numbers texts that are numbers, strings in lower case; facet brand is a column, the others
    are keys of the JSON text in specs. Facets without values, and keys of another form than FACET_KEY, don't filter.
    """
    out = F.lit(True)
    for key, given in filters.items():
        several = isinstance(given, Collection) and not isinstance(given, str)
        values = [v for v in (given if several else [given]) if v is not None and v != ""]
        if not re.fullmatch(FACET_KEY, key or "") or not values:
            continue
        if key == "brand":
            hit = F.lower(F.coalesce(brand, F.lit(""))).isin([str(v).lower() for v in values])
        elif all(isinstance(v, bool) for v in values):
            hit = F.lower(text_in(F.col(specs), key)).isin([str(v).lower() for v in values])
        elif all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            text = text_in(F.col(specs), key)
            hit = F.when(text.rlike(NUMBER), text.cast("double")).isin([float(v) for v in values])
        else:
            hit = F.lower(F.coalesce(text_in(F.col(specs), key), F.lit(""))).isin([str(v).lower() for v in values])
        out = out & F.coalesce(hit, F.lit(False))
    return out


def allowed(json: Column, keys: Collection[str]) -> Column:
    """The JSON object with the allowed keys alone, values that are null or empty texts left out; null for other kinds."""
    known = F.map_filter(entries(json), lambda k, v: k.isin(list(keys)) & ~F.coalesce(F.schema_of_variant(v) == "VOID", F.lit(True)) & ~F.coalesce(F.try_variant_get(v, "$", "string") == "", F.lit(False)))
    return F.to_json(known)


def half_even(value: Column, digits: int) -> Column:
    """Rounded with ties to even, on doubles."""
    return F.bround(value.cast("double"), digits)


def half_up(value: Column, digits: int) -> Column:
    """Rounded with ties away from zero, on decimals."""
    return F.round(value.cast("decimal(38,10)"), digits)


def depth_snapshot(plans: DataFrame, purpose: str, deep: int = 8) -> DataFrame:
    """platform, n_plans, saturated, past_deep, max_page, new_ids of the plans of a purpose: aggregates over paths of their metadata.

    Paths that are missing or no whole numbers count as 0; texts that don't parse have no purpose.
    """
    meta = F.col("metadata")
    page, new = (F.coalesce(F.try_variant_get(F.try_parse_json(meta), at(f"cursor.{name}"), "string").try_cast("long"), F.lit(0)) for name in ("last_page", "new_ids"))
    rows = plans.where(text_in(meta, "purpose") == purpose).select("platform", (text_in(meta, "completion") == "saturated").alias("full"), page.alias("page"), new.alias("new"))
    return rows.groupBy("platform").agg(F.count("*").alias("n_plans"), F.count_if("full").alias("saturated"), F.count_if(F.col("page") > deep).alias("past_deep"), F.max("page").alias("max_page"), F.sum("new").alias("new_ids"))
