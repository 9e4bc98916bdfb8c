"""Ordered pages, merged buckets, cursors, comparison rows and card signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets that a cursor may name.
MOST_OFFSET = 5_000
#: Windows of price history by name, and the days they cover.
WINDOW_DAYS = {"30d": 30, "90d": 90, "180d": 180, "6m": 180, "1y": 365, "all": 3650}
# Colour names in titles, in order.
COLORS = (
    r"\b(black|white|silver|gold|blue|red|green|pink|purple|grey|gray|titanium|natural|desert|ultramarine|teal|midnight|starlight|graphite|burgundy|"
    r"glacier|cosmic\s*orange|orange|yellow|violet|lavender|mint|cream|beige|space\s*black|space\s*grey|space\s*gray|phantom\s*black|deep\s*purple)\b"
)
PRICE = r"((?:₹|rs\.?|inr)\s?[0-9,]+(?:\.[0-9]+)?)"


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows after the first `offset` in that order, `limit` at most, with position (from 1): a declared top-k."""
    top = rows.orderBy(*order).limit(offset + limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > offset)


def search_order(mode: str) -> list[Column]:
    """Orders of search results: by price either way, last check, or relevance; nulls last, ties by id."""
    tail = [F.desc("rank_score"), F.desc("platform_count"), F.col("last_seen_at").desc_nulls_last(), F.asc("product_id")]
    if mode == "price_asc":
        return [F.col("best_price").asc_nulls_last(), *tail]
    if mode == "price_desc":
        return [F.col("best_price").desc_nulls_last(), *tail]
    if mode == "recently_checked":
        return [F.col("last_seen_at").desc_nulls_last(), F.desc("platform_count"), F.col("best_price").asc_nulls_last(), F.asc("product_id")]
    group = F.when(F.col("match_group") == "exact_match", 3).when(F.col("match_group") == "similar_variant", 2).otherwise(1)
    return [group.desc(), *tail]


def merged(buckets: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Rows (key, position) of several short ordered lists as one: each key where it comes first, `limit` at most."""
    rows = reduce(DataFrame.unionByName, [b.select(key, F.lit(i).alias("bucket"), F.col("position").alias("at")) for i, b in enumerate(buckets)])
    first = rows.groupBy(key).agg(F.min(F.struct("bucket", "at")).alias("first")).select(key, "first.bucket", "first.at")
    return page(first, [F.asc("bucket"), F.asc("at"), F.asc(key)], limit).drop("at")


def cursor(offset: Column) -> Column:
    """A page's offset as base64url of JSON, without padding."""
    return F.rtrim(F.translate(F.base64(F.concat(F.lit('{"offset":'), offset.cast("string"), F.lit("}")).cast("binary")), "+/", "-_"), F.lit("="))


def offset_of(text: Column) -> Column:
    """The offset in a cursor; null if it names none from 0 to MOST_OFFSET."""
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_to_binary(F.translate(padded, "-_", "+/"), F.lit("base64"))
    found = F.regexp_extract(raw.cast("string"), r'^\{"offset": ?(-?[0-9]{1,9})\}$', 1)
    value = F.when(found != "", found).cast("long")
    return F.when(value.between(0, MOST_OFFSET), value)


def history_days(window: Column, days: Column) -> Column:
    """Days of a named window or of 'Nd' (1 to 3650), else the days given, else 90."""
    key = F.lower(F.trim(window))
    named = F.create_map(*(F.lit(x) for pair in WINDOW_DAYS.items() for x in pair))[key]
    clamped = lambda n: F.greatest(F.lit(1), F.least(n, F.lit(3650)))
    own = F.when(key.rlike("^[0-9]{1,9}d$"), clamped(F.regexp_extract(key, "^([0-9]+)d$", 1).cast("long")))
    given = F.when(days.isNotNull(), clamped(days.cast("long")))  # least and greatest skip nulls
    return F.coalesce(named.cast("long"), own, given, F.lit(90))


def rotation(as_of: Column, n: Column) -> Column:
    """A day's place in a rotation of n: days since the year 1, modulo n."""
    return (F.datediff(as_of, F.lit("0001-01-01").cast("date")) + 1) % n


def clean_price(text: Column, low: int = 100, high: int = 2_000_000) -> Column:
    """Whole currency units of the first price with a currency sign, else of the whole text; null out of bounds."""
    t = F.trim(text)
    marked = F.regexp_extract(F.lower(t), PRICE, 1)
    chosen = F.regexp_replace(F.trim(F.when(marked != "", marked).otherwise(t)), r"\.[0-9]{1,2}$", "")
    digits = F.regexp_replace(chosen, "[^0-9]", "")
    value = F.when((F.length(digits) > 0) & (F.length(digits) <= 18), digits).cast("long")
    return F.when(value.between(low, high) & ~F.upper(t).isin("N/A", "NA", "NONE", "NULL", "COMPARE"), value)


def color_of(title: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(F.lower(title), COLORS, 1), r"\s+", " ")
    return F.when(found != "", found)


def compared(rows: DataFrame, group: str, keys: tuple[str, ...]) -> DataFrame:
    """For each group of products and each specification that one of them has: how many have it, how many values, and
    whether they differ (also where one has none)."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.lower(F.col(k).cast("string")).alias("value")) for k in keys))
    long = rows.select(group, F.explode(entries).alias("e")).select(group, "e.key", "e.value")
    by = long.groupBy(group, "key").agg(F.count("*").alias("n"), F.count("value").alias("n_present"), F.count_distinct("value").alias("n_values")).where("n_present > 0")
    return by.withColumn("differs", (F.col("n_values") > 1) | (F.col("n_present") < F.col("n")))


def card_signals(products: DataFrame) -> DataFrame:
    """Adds kind to products (dropped, near_low, stores, hours since the last check): the first that holds of a drop of 100
    units, near the tracked low, three stores, checked within a day, two stores; else null."""
    kind = (
        F.when(F.col("dropped") >= 10_000, "drop").when(F.col("near_low"), "low").when(F.col("stores") >= 3, "stores")
        .when(F.col("hours") <= 24, "freshness").when(F.col("stores") == 2, "stores")
    )
    return products.withColumn("kind", kind)


def verification(expected: DataFrame, tasks: DataFrame, as_of: str, most: int = 20) -> DataFrame:
    """product_id, expected_stores, active_tasks, oldest_seconds, status: of each product's `most` oldest active tasks.

    expected: product_id, expected_stores; tasks: product_id, task_id, status, created_at.
    """
    active = tasks.where(F.col("status").isin("pending", "running", "queued", "paused"))
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy("created_at", "task_id"))
    age = F.lit(as_of).cast("timestamp_ntz")
    seconds = F.expr("timestampdiff(SECOND, created_at, at)")
    few = active.withColumn("rn", rn).where(F.col("rn") <= most).withColumn("at", age)
    by = few.groupBy("product_id").agg(F.count("*").alias("active_tasks"), F.max(seconds).alias("oldest_seconds"), F.bool_or(F.col("status") == "running").alias("running"))
    out = expected.join(by, "product_id", "left")
    status = F.when(F.col("running"), "running").when(F.col("active_tasks") > 0, "queued").otherwise("idle")
    return out.select("product_id", "expected_stores", F.coalesce("active_tasks", F.lit(0)).alias("active_tasks"), "oldest_seconds", status.alias("status"))
