"""Audit reports over products, listings and titles; quality gate; merging rows; watches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, key: str, order: list, id_col: str) -> DataFrame:
    """Rows of one key: how many, which survives (the first of the order), and a row for each other one to retire."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumns({"rn": F.row_number().over(w), "survivor": F.first(id_col).over(w)})
    return ranked.where("rn > 1").select(key, F.col(id_col).alias("retired"), "survivor", (F.col("rn") - 1).cast("long").alias("place"))


def orphans(documents: DataFrame, listings: DataFrame) -> DataFrame:
    """Documents of products without a listing."""
    return documents.join(listings.select("product_id").distinct(), "product_id", "left_anti")


def ladder_counts(rows: DataFrame, by: str, value: str, steps: tuple[int, ...]) -> DataFrame:
    """For each group, rows at or above each step, and the exact median."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col(value) >= s).alias(f"at_least_{s}") for s in steps), F.expr(f"percentile({value}, 0.5)").alias("median"))


def price_mismatches(best: DataFrame, listings: DataFrame) -> DataFrame:
    """Products whose document price isn't the least of their listings' prices (null-safe)."""
    least = listings.groupBy("product_id").agg(F.min("price").alias("least"))
    rows = best.select("product_id", "best_price").join(least, "product_id", "left")
    return rows.where(~F.col("best_price").eqNullSafe(F.col("least"))).withColumn("kind", F.when(F.col("best_price").isNull(), "no_best").when(F.col("best_price") > F.col("least"), "above_least").otherwise("below_least"))


def suspect_clusters(listings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Products whose listings hold two or more values of an identity key: product_id, key, n_values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys)))
    by = listings.select("product_id", pairs.alias("x")).groupBy("product_id", "x.key").agg(F.count_distinct("x.value").alias("n_values"))
    return by.where("n_values > 1")


def same_platform_duplicates(listings: DataFrame) -> DataFrame:
    """Products with several listings on one platform, and in how many colours and prices."""
    by = listings.groupBy("product_id", "platform").agg(F.count("*").alias("n"), F.count_distinct("color").alias("n_colors"), F.count_distinct("price").alias("n_prices"))
    cause = F.when(F.col("n_colors") == F.col("n"), "colours").when(F.col("n_prices") == 1, "same_price").otherwise("mixed")
    return by.where("n > 1").withColumn("cause", cause)


def bands(rows: DataFrame, value: str, width: int) -> DataFrame:
    """Rows by bands of a width."""
    return rows.groupBy((F.floor(F.col(value) / width) * width).alias("band")).agg(F.count("*").alias("n"))


def buckets(rows: DataFrame, value: str, bounds: tuple[int, ...]) -> DataFrame:
    """Cumulative buckets, sum and count: one row for each bound and one for infinity (null)."""
    at = F.explode(F.array(*(F.lit(b) for b in bounds), F.lit(None).cast("int")))
    return rows.select(F.col(value).alias("v"), at.alias("bound")).groupBy("bound").agg(F.count_if(F.col("bound").isNull() | (F.col("v") <= F.col("bound"))).alias("n"), F.sum("v").alias("total"))


def precision_recall(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of a binary prediction and its precision and recall."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    by = scored.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return by.withColumn("precision", F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), 4)).withColumn("recall", F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)), 4))


def quality_gate(listings: DataFrame, low: int = 100, high: int = 1_000_000) -> DataFrame:
    """Flags, decision and use of each listing: title, price, mrp, platform; repeated keys in id order are duplicates."""
    rn = F.row_number().over(Window.partitionBy("title", "platform", "price").orderBy("listing_id"))
    rows = listings.withColumn("rn", rn)
    rules = {
        "price_out_of_bounds": ~F.col("price").between(low, high), "mrp_below_price": F.col("mrp") < F.col("price"), "discount_suspicious": F.col("mrp") > F.col("price") * 10,
        "duplicate_offer": F.col("rn") > 1, "needs_review": F.col("match_status") == "needs_review",
    }
    flags = F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("flags", flags)
    has = lambda code: F.array_contains("flags", code)
    decision = F.when(has("price_out_of_bounds") | has("duplicate_offer"), "rejected").when(F.size("flags") > 0, "degraded").otherwise("accepted")
    return rows.select("listing_id", "product_id", F.array_join("flags", ",").alias("flags"), decision.alias("decision"), (~has("price_out_of_bounds") & ~has("mrp_below_price")).alias("price_usable"))


def refresh_checks(events: DataFrame, drop_percent: int = 70, spike: int = 3) -> DataFrame:
    """Observations whose price falls or rises implausibly against the one before."""
    rows = events.where("previous > 0")
    flag = F.when(F.col("price") * 100 < F.col("previous") * (100 - drop_percent), "drop").when(F.col("price") > F.col("previous") * spike, "spike")
    return rows.withColumn("flag", flag).where("flag is not null").select("observation_id", "listing_id", "previous", "price", "flag")


def upsert(old: DataFrame, new: DataFrame, key: str, latest: str) -> DataFrame:
    """Rows of old and new by key: the last row's values win where they aren't null; the smallest first, largest last time."""
    values = [c for c in old.columns if c not in (key, latest)]
    both = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    at = F.struct(latest, "fresh")
    by = both.groupBy(key)
    return by.agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in values), F.min(latest).alias("first_seen"), F.max(latest).alias("last_seen"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there yet, once each."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def watch_events(watches: DataFrame, events: DataFrame) -> DataFrame:
    """Events for users who watch a product: target reached, meaningful drop, back in stock, out of stock.

    events: product_id, kind, price, previous, stock (price_events). A drop is meaningful from 2 % or 500 units; a product out
    of stock is never at its target. The fingerprint makes each event unique.
    """
    each = watches.groupBy("user_id", "product_id").agg(F.collect_set("target").alias("targets"), F.max("notify_on_drop").alias("notify_on_drop"))
    kind = lambda name: F.coalesce(F.max(F.col("kind") == name), F.lit(False)).alias(name)
    # equal events and equal watches are one row before they meet, so that what comes out is different as it is
    rows = each.join(events.groupBy("product_id", "price", "previous", "stock").agg(kind("back_in_stock"), kind("out_of_stock")), "product_id")
    stocked = F.col("stock") != "out_of_stock"
    fall = F.col("previous") - F.col("price")
    rules = {
        "AT_TARGET": stocked & F.exists("targets", lambda t: (F.col("price") <= t) & (F.col("previous").isNull() | (F.col("previous") > t))),
        "PRICE_DROP": F.col("notify_on_drop") & stocked & ((fall * 50 >= F.col("previous")) | (fall >= 50_000)) & (fall > 0),
        "BACK_IN_STOCK": F.col("back_in_stock"), "OUT_OF_STOCK": F.col("out_of_stock"),
    }
    kinds = F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("event", F.explode(kinds))
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("product_id").cast("string"), "event", F.col("price").cast("string"), F.coalesce(F.col("previous").cast("string"), F.lit("")), "stock")
    return rows.select("user_id", "product_id", "event", "price", "previous", "stock", F.sha2(key, 256).alias("fingerprint"))


def watch_states(watches: DataFrame, best: DataFrame, latest: DataFrame) -> DataFrame:
    """State of each watch by the best price now and the product's latest event (product_id, kind)."""
    rows = watches.join(best.select("product_id", "best_price", "used_fallback"), "product_id", "left").join(latest, "product_id", "left")
    state = (
        F.when(F.col("best_price").isNull(), "UNAVAILABLE").when(F.col("used_fallback"), "OUT_OF_STOCK").when(F.col("best_price") <= F.col("target"), "AT_TARGET")
        .when(F.col("kind") == "back_in_stock", "BACK_IN_STOCK").when((F.col("kind") == "drop") & F.col("notify_on_drop"), "DROPPED").when(F.col("best_price") * 100 <= F.col("target") * 110, "NEAR_TARGET").otherwise("WATCHING")
    )
    return rows.select("user_id", "product_id", "target", "best_price", state.alias("state"))


def latest_event(events: DataFrame) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("observed_at"), F.desc("observation_id")))
    return events.withColumn("rn", rn).where("rn = 1").select("product_id", "kind")


def nested_export(products: DataFrame, offers: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each product with its platforms as a map of structs and its history as an array of structs."""
    by_platform = offers.groupBy("product_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", F.struct("price", "stock"))))).alias("platforms"))
    history = days.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("day", "best_price"))).alias("history"))
    return products.join(by_platform, "product_id", "left").join(history, "product_id", "left")


def numbered(rows: DataFrame, key: str, width: int = 500, wide: int = 1_000) -> DataFrame:
    """Adds number, the row's place (from 1) in the order of key (long, unique), without bringing all rows to one task.

    Rows are ranked in ranges of `width` keys; ranges' counts are summed up within `wide` ranges, and the counts of those
    in turn, so that only one row for each width * wide keys meets in a task.
    """
    from pyspark.sql import Window

    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("range", F.floor(F.col(key) / width))
    ranges = rows.groupBy("range").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("range") / wide))
    blocks = ranges.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block")).alias("block_before"))
    ranges = ranges.withColumn("range_before", before(Window.partitionBy("block").orderBy("range"))).join(blocks, "block")
    place = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return rows.withColumn("place", place).join(ranges.select("range", "range_before", "block_before"), "range").withColumn("number", F.col("block_before") + F.col("range_before") + F.col("place")).drop("range", "place", "range_before", "block_before")
