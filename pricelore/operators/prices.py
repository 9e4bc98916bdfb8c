"""Offers, best prices, rollups, history, statistics and price timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of platform and category whose offers aren't shown; a null category stands for all.
HIDDEN = (("jiomart", "laptop"), ("jiomart", "camera"), ("bajajelectronics", None))
OUT_OF_STOCK = ("out_of_stock",)
OUT_OF_STOCK_WIDE = ("out_of_stock", "unavailable", "oos")


def public_offer(platform: Column, category: Column, hidden=HIDDEN) -> Column:
    """Whether offers of this platform and category are shown."""
    gate = F.lit(True)
    for p, c in hidden:
        gate = gate & ~((platform == p) & (F.lit(True) if c is None else category == c))
    return gate


def public_priced(listings: DataFrame) -> Column:
    """A price above 0 in INR (the default), a sure match, and a public platform and category."""
    c = listings
    return (
        F.coalesce(c["price"] > 0, F.lit(False)) & (F.coalesce(c["currency"], F.lit("INR")) == "INR") & F.coalesce(c["match_status"] == "matched", F.lit(False))
        & public_offer(c["platform"], c["category"])
    )


def best_price(products: DataFrame, listings: DataFrame, out_of_stock=OUT_OF_STOCK, oos_fallback: bool = True) -> DataFrame:
    """Best price of each active product over all its public listings: in stock, else (with oos_fallback) any.

    product_id, best_price, best_platform (ties to the smaller name), platform_count, listing_count, last_seen, used_fallback.
    Listings are aggregated before the join, so that only one row a product meets it.
    """
    shown = listings.where(public_priced(listings))
    stocked = ~F.coalesce(F.col("stock").isin(*out_of_stock), F.lit(False))
    offer = F.struct("price", "platform")
    by = shown.groupBy("product_id").agg(
        F.min(F.when(stocked, offer)).alias("in_stock"), F.min(offer).alias("any"), F.count_distinct("platform").alias("platform_count"),
        F.count("*").alias("listing_count"), F.max("last_seen").alias("last_seen"),
    )
    best = F.coalesce("in_stock", "any") if oos_fallback else F.col("in_stock")
    out = products.where("status = 'active'").select("product_id", "category").join(by.withColumn("best", best), "product_id", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "product_id", "category", F.col("best.price").alias("best_price"), F.col("best.platform").alias("best_platform"),
        F.coalesce("platform_count", none).alias("platform_count"), F.coalesce("listing_count", none).alias("listing_count"), "last_seen",
        (F.col("in_stock").isNull() & F.col("best").isNotNull()).alias("used_fallback"),
    )


def select_offers(listings: DataFrame, products: DataFrame, out_of_stock=OUT_OF_STOCK_WIDE) -> DataFrame:
    """The one listing that stands for each product and platform.

    Order of choice: priced, of the product's colour (then of unknown colour), priced and in stock, cheaper, seen later,
    smaller id.
    """
    rows = listings.join(products.select("product_id", F.col("color").alias("wanted")), "product_id")
    priced = public_priced(rows)
    rank = F.when(F.col("wanted").isNull() | F.col("color").isNull(), 1).when(F.col("color") == F.col("wanted"), 0).otherwise(2)
    gone = F.coalesce(F.col("stock").isin(*out_of_stock), F.lit(False))
    order = [(~priced).asc(), rank.asc(), (~(priced & ~gone)).asc(), F.col("price").asc_nulls_last(), F.col("last_seen").desc_nulls_last(), F.col("listing_id").asc()]
    chosen = rows.withColumn("rn", F.row_number().over(Window.partitionBy("product_id", "platform").orderBy(*order))).where("rn = 1").drop("rn", "wanted")
    return chosen.withColumn("priced", public_priced(chosen)).withColumn("in_stock", ~F.coalesce(chosen["stock"].isin(*out_of_stock), F.lit(False)))


def public_offers(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Offers of each product in the order of show: in stock and priced first, then cheaper, then by platform."""
    shown = listings.where(public_offer(F.col("platform"), F.col("category")) & (F.coalesce("currency", F.lit("INR")) == "INR"))
    offers = select_offers(shown, products)
    order = [(~(F.col("priced") & F.col("in_stock"))).asc(), F.col("price").asc_nulls_last(), F.col("platform").asc()]
    return offers.withColumn("position", F.row_number().over(Window.partitionBy("product_id").orderBy(*order)).cast("long"))


def best_unique_price(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Best price after one listing stands for each retailer; used_fallback tells that none is in stock."""
    offers = select_offers(listings, products).where("priced")
    offer = F.struct("price", "platform")
    by = offers.groupBy("product_id").agg(F.min(F.when(F.col("in_stock"), offer)).alias("a"), F.min(offer).alias("b"), F.count("*").alias("platform_count"))
    best = F.coalesce("a", "b")
    return by.select("product_id", best["price"].alias("best_price"), best["platform"].alias("best_platform"), "platform_count", F.col("a").isNull().alias("used_fallback"))


def offer_counts(listings: DataFrame) -> DataFrame:
    """Platforms with a public price, and such listings, of each product."""
    return listings.where(public_priced(listings)).groupBy("product_id").agg(F.count_distinct("platform").alias("offer_count"), F.count("*").alias("listing_count"))


def listing_ohlc(observations: DataFrame, bucket: str = "day") -> DataFrame:
    """Open, high, low and close of each listing and period; last mrp; counts."""
    at = F.struct("observed_at", "observation_id")
    rows = observations.where("price is not null")
    period = F.to_date(F.date_trunc(bucket, "observed_at"))
    return rows.groupBy("listing_id", period.alias("period")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.max_by("mrp", at).alias("last_mrp"), F.count("*").alias("n"), F.count_if(F.col("stock") == "in_stock").alias("n_in_stock"),
    )


def product_days(platform_days: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    """Daily rollup of each product: a column of each platform's price, the best, and the lowest so far."""
    best = F.min(F.struct("min_price", "platform"))
    by = platform_days.groupBy("product_id", "day").agg(
        *(F.min(F.when(F.col("platform") == p, F.col("min_price"))).alias(f"{p}_price") for p in platforms),
        best.alias("best"), F.count_distinct("platform").alias("platform_count"), F.sum("n").alias("n"),
    )
    low = F.min("best_price").over(Window.partitionBy("product_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    out = by.withColumns({"best_price": F.col("best.min_price"), "best_platform": F.col("best.platform")}).drop("best")
    return out.withColumn("all_time_low", low)


def product_days_again(observations: DataFrame, changed: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    """The rollups that change when observations of changed (product_id, day) come in: those products, from that day on."""
    first = changed.groupBy("product_id").agg(F.min("day").alias("from_day"))
    rows = observations.join(first, "product_id")
    days = rows.groupBy("product_id", "day", "platform").agg(F.min("price").alias("min_price"), F.count("*").alias("n"))
    return product_days(days, platforms).join(first, "product_id").where("day >= from_day").drop("from_day")


def price_history(platform_days: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Days of the window: the best price, each platform's as a map, listings in stock."""
    days = max(1, min(days, 3650))
    rows = platform_days.where((F.col("day") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("day") <= F.lit(as_of).cast("date")))
    prices = F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "min_price"))))
    return rows.groupBy("product_id", "day").agg(F.min("min_price").alias("best_price"), prices.alias("platform_prices"), F.sum("n_in_stock").alias("n_in_stock"), F.sum("n").alias("n_seen"))


def daily_best(platform_days: DataFrame) -> DataFrame:
    return platform_days.where("min_price > 0").groupBy("product_id", "day").agg(F.min("min_price").alias("price"))


def window_stats(daily: DataFrame, as_of: str, windows: dict[str, int]) -> DataFrame:
    """For each product and window (name: days): observed days, span, low, high, latest, percentile, volatility, last change.

    One pass: every row counts in each window that holds it. percentile is the share (in %) of days at or below the
    latest price; volatility is the deviation over the mean, from three days on.
    """
    end = F.lit(as_of).cast("date")
    rows = daily.where((F.col("price") > 0) & (F.col("day") <= end))
    inside = F.filter(F.array(*(F.when(F.col("day") > F.date_sub(end, n), F.lit(w)) for w, n in windows.items())), lambda w: w.isNotNull())
    rows = rows.withColumn("window", F.explode(inside))
    order = Window.partitionBy("product_id", "window").orderBy("day")
    rows = rows.withColumn("before", F.lag("price").over(order)).withColumn("latest", F.last("price").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    by = rows.groupBy("product_id", "window").agg(
        F.count("*").alias("n"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("span"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.max("latest").alias("latest"), F.sum((F.col("price") <= F.col("latest")).cast("long")).alias("at_or_below"), F.max_by("before", "day").alias("previous"),
        F.stddev_pop("price").alias("dev"), F.avg("price").alias("mean"),
    )
    return by.select(
        "product_id", "window", "n", "span", "low", "high", "latest", (F.col("latest") - F.col("previous")).alias("change"),
        F.when(F.col("n") >= 2, F.round(100.0 * F.col("at_or_below") / F.col("n"), 1)).alias("percentile"),
        F.when(F.col("n") >= 3, F.round(F.col("dev") / F.col("mean"), 4)).alias("volatility"),
    )


def offer_state(listings: DataFrame, as_of: str) -> DataFrame:
    """Of each product: public stores, stores in stock, best price in stock, hours since the newest check."""
    rows = listings.where(public_priced(listings))
    stocked = ~F.col("stock").isin(*OUT_OF_STOCK_WIDE)
    hours = F.greatest(F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz")) - F.unix_timestamp("last_seen")) / 3600), F.lit(0).cast("long"))
    return rows.groupBy("product_id").agg(
        F.count_distinct("platform").alias("stores"), F.count_distinct(F.when(stocked, F.col("platform"))).alias("stores_in_stock"),
        F.min(F.when(stocked, F.col("price"))).alias("current"), F.min(hours).alias("hours"),
    )


def timing(products: DataFrame, offers: DataFrame, stats: DataFrame, min_days: int = 7, min_span: int = 14, stale_hours: int = 24) -> DataFrame:
    """State of each product's price: the first rule that applies.

    offers: offer_state; stats: window_stats with the windows 90d and tracked. The 90 days are the evidence where they hold
    enough days, else all tracked days.
    """
    pick = lambda w: stats.where(F.col("window") == w).select("product_id", F.struct("n", "span", "low", "latest", "change").alias(f"w_{w}"))
    rows = products.select("product_id").join(offers, "product_id", "left").join(pick("90d"), "product_id", "left").join(pick("tracked"), "product_id", "left")
    enough = F.coalesce(F.col("w_90d.n") >= min_days, F.lit(False))
    rows = rows.withColumn("e", F.when(enough, F.col("w_90d")).otherwise(F.col("w_tracked"))).withColumn("evidence", F.when(enough, "90d").otherwise("tracked"))
    low, current = F.col("e.low"), F.col("current")
    gap = (current - low) / low
    previous = F.col("e.latest") - F.col("e.change")
    dropped = F.coalesce((F.col("e.change") < 0) & ((-F.col("e.change") >= 10_000) | (-F.col("e.change") * 100 >= previous * 2)), F.lit(False))
    none = F.lit(0).cast("long")
    n, span = F.coalesce("e.n", none), F.coalesce("e.span", none)
    code = (
        F.when(F.coalesce("stores", none) == 0, "NO_PRICED_OFFERS").when(F.col("stores_in_stock") == 0, "OOS_ONLY").when(current.isNull(), "NO_IN_STOCK_PRICE")
        .when((n < min_days) | (span < min_span), "INSUFFICIENT_HISTORY").when(F.col("hours") > stale_hours, "STALE_OFFERS")
        .when((gap <= 0.03) & (F.col("stores_in_stock") >= 2), "NEAR_RECENT_LOW").when((gap >= 0.08) & dropped, "RECENT_DROP_ABOVE_LOW")
        .when(gap >= 0.08, "ABOVE_RECENT_LOW").otherwise("WATCH")
    )
    state = (
        F.when(code.isin("NO_PRICED_OFFERS", "OOS_ONLY", "NO_IN_STOCK_PRICE"), "UNAVAILABLE").when(code == "INSUFFICIENT_HISTORY", code)
        .when(code == "NEAR_RECENT_LOW", "CONSIDER_NOW").when(code == "ABOVE_RECENT_LOW", "WAIT_FOR_BETTER_PRICE").otherwise("WATCH")
    )
    return rows.select("product_id", state.alias("state"), code.alias("code"), "evidence", F.coalesce("stores", none).alias("stores"), F.coalesce("stores_in_stock", none).alias("stores_in_stock"), current.alias("current"), low.alias("low"))


def contradictions(signals: DataFrame) -> DataFrame:
    """Codes of signals that contradict their own figures."""
    c = F.col
    rules = {
        "BUY_WITHOUT_STOCK": (c("state") == "CONSIDER_NOW") & (c("stores_in_stock") == 0), "BUY_WITHOUT_LOW": (c("state") == "CONSIDER_NOW") & c("low").isNull(),
        "BUY_FAR_ABOVE_LOW": (c("state") == "CONSIDER_NOW") & (c("current") * 100 > c("low") * 103), "WAIT_AT_LOW": (c("state") == "WAIT_FOR_BETTER_PRICE") & (c("current") <= c("low")),
        "UNAVAILABLE_WITH_STOCK": (c("state") == "UNAVAILABLE") & (c("stores_in_stock") > 0), "MORE_STOCK_THAN_STORES": c("stores_in_stock") > c("stores"),
        "BELOW_TRACKED_LOW": c("current") < c("low"), "PRICE_WITHOUT_STOCK": c("current").isNotNull() & (c("stores_in_stock") == 0),
    }
    codes = F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda x: x.isNotNull())
    return signals.withColumn("codes", codes)


def insight(daily: DataFrame, current: DataFrame) -> DataFrame:
    """Current price against the history's statistics: near its low, above its average, or typical."""
    by = daily.where("price > 0").groupBy("product_id").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean"))
    rows = current.join(by, "product_id")
    label = (
        F.when(F.col("n") < 3, "Limited data").when(F.col("price") <= F.col("low") * 1.03, "Near observed low").when(F.col("price") > F.col("mean") * 1.08, "Above recent average").otherwise("Typical")
    )
    return rows.select("product_id", "n", "low", "high", "price", label.alias("label"))


def price_events(observations: DataFrame) -> DataFrame:
    """Each observation's kind against its listing's one before: out of stock and back come before price moves."""
    order = Window.partitionBy("listing_id").orderBy("observed_at", "observation_id")
    rows = observations.withColumns({"before": F.lag("price").over(order), "stock_before": F.lag("stock").over(order)})
    kind = (
        F.when(F.col("stock_before").isNull(), "initial").when((F.col("stock") == "out_of_stock") & (F.col("stock_before") != "out_of_stock"), "out_of_stock")
        .when((F.col("stock") != "out_of_stock") & (F.col("stock_before") == "out_of_stock"), "back_in_stock")
        .when(F.col("price") < F.col("before"), "drop").when(F.col("price") > F.col("before"), "rise").otherwise("unchanged")
    )
    return rows.select("observation_id", "listing_id", "product_id", "platform", "observed_at", "price", F.col("before").alias("previous"), "stock", kind.alias("kind"))
