"""Home page rails: drops, discounts, tracked lows, multi-store picks, and their assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelore.operators.prices import public_priced


def price_drops(daily: DataFrame, products: DataFrame, max_gap_days: int = 30, least_percent: float = 2.0, least_amount: int = 10_000) -> DataFrame:
    """Each product's last day against the day before it (no more than max_gap_days back), where the price fell enough."""
    order = Window.partitionBy("product_id").orderBy("day")
    rows = daily.withColumns({"previous": F.lag("price").over(order), "previous_day": F.lag("day").over(order), "next_day": F.lead("day").over(order)})
    last = rows.where(F.col("next_day").isNull() & (F.col("previous_day") >= F.date_sub("day", max_gap_days)))
    drop = F.col("previous") - F.col("price")
    percent = F.round(100.0 * drop / F.col("previous"), 2)
    last = last.where((drop > 0) & ((percent >= least_percent) | (drop >= least_amount)))
    return last.select("product_id", "day", "price", "previous", drop.alias("drop"), percent.alias("percent")).join(products.where("status = 'active'").select("product_id", "category"), "product_id")


def biggest_discounts(listings: DataFrame, least: float = 0.05, most: float = 0.9) -> DataFrame:
    """The largest discount off the listed price of each product, within bounds."""
    share = F.round((F.col("mrp") - F.col("price")) / F.col("mrp"), 4)
    rows = listings.where(public_priced(listings) & (F.col("mrp") > 0)).withColumn("discount", share).where((F.col("discount") >= least) & (F.col("discount") < most))
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("discount"), "price", "listing_id"))
    return rows.withColumn("rn", rn).where("rn = 1").select("product_id", "category", "listing_id", "platform", "price", "mrp", "discount")


def tracked(daily: DataFrame) -> DataFrame:
    return daily.groupBy("product_id").agg(F.min("price").alias("low"), F.count("*").alias("n"), F.count_distinct("day").alias("days"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("span"))


def at_tracked_low(best: DataFrame, daily: DataFrame, least_days: int = 2) -> DataFrame:
    """Products whose best price is at or below all tracked ones."""
    return best.where("best_price is not null").join(tracked(daily), "product_id").where((F.col("best_price") <= F.col("low")) & (F.col("n") >= 2) & (F.col("days") >= least_days)).select("product_id", "category", "best_price", "low", "days")


def near_tracked_low(best: DataFrame, daily: DataFrame, percent: int = 5, least_n: int = 7, least_span: int = 14) -> DataFrame:
    """Products whose best price is above the tracked low, by at most `percent`."""
    rows = best.where("best_price is not null").join(tracked(daily), "product_id")
    rows = rows.where((F.col("best_price") > F.col("low")) & (F.col("best_price") * 100 <= F.col("low") * (100 + percent)) & (F.col("n") >= least_n) & (F.col("span") >= least_span))
    return rows.select("product_id", "category", "best_price", "low", F.round(100.0 * (F.col("best_price") - F.col("low")) / F.col("low"), 1).alias("gap_percent"))


def multi_store(best: DataFrame, limit: int, preferred: int = 3, least: int = 2) -> DataFrame:
    """Products of `preferred` stores or more, if there are `limit` of them, else of `least` or more; in one scan."""
    rows = best.where(F.col("platform_count") >= least)
    enough = rows.agg((F.count_if(F.col("platform_count") >= preferred) >= limit).alias("enough"))
    return rows.crossJoin(F.broadcast(enough)).where(~F.col("enough") | (F.col("platform_count") >= preferred)).drop("enough")  # enough is one row


def diverse(rows: DataFrame, order: list[Column], limit: int, cap: int | None = None) -> DataFrame:
    """Round-robin over categories (in alphabetical order), at most `cap` of each before the rest fill up; adds position."""
    cap = cap if cap is not None else max(2, min(3, (limit + 2) // 3))
    rn = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    rows = rows.withColumn("rn", rn).where(F.col("rn") <= limit)
    turn = [(F.col("rn") > cap).asc(), F.when(F.col("rn") <= cap, F.col("rn")).asc_nulls_last(), F.col("category").asc(), F.col("rn").asc()]
    return numbered(rows.orderBy(*turn).limit(limit), turn).drop("rn")


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Numbers from 1 in the given order; for a limited number of rows."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def interleaved(rows: DataFrame, group: str, order: list[Column], group_order: Column) -> DataFrame:
    """turn: the rank in the row's group; read in the order of (turn, group_order) the groups take turns."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).withColumn("group_rank", group_order)


def first_section(rails: DataFrame, soft_min: int = 3) -> DataFrame:
    """Each product stays in its first rail; a rail left with fewer than soft_min takes back its first repeats.

    rails: rail (number), position, product_id.
    """
    first = F.min("rail").over(Window.partitionBy("product_id"))
    rows = rails.withColumn("fresh", F.col("rail") == first)
    n_fresh = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("rail"))
    again = F.row_number().over(Window.partitionBy("rail", "fresh").orderBy("position"))
    rows = rows.withColumns({"n_fresh": n_fresh, "again": again})
    kept = rows.where(F.col("fresh") | (F.col("again") <= soft_min - F.col("n_fresh")))
    return kept.select("rail", "position", "product_id", "fresh")


def overlap(rails: DataFrame) -> DataFrame:
    """Shared share of each two rails: common products over the smaller rail's size."""
    sizes = rails.groupBy("rail").agg(F.count_distinct("product_id").alias("size"))
    pairs = rails.select(F.col("rail").alias("left"), "product_id").distinct().join(rails.select(F.col("rail").alias("right"), "product_id").distinct(), "product_id").where("left < right")
    both = pairs.groupBy("left", "right").agg(F.count("*").alias("common"))
    both = both.join(sizes.select(F.col("rail").alias("left"), F.col("size").alias("a")), "left").join(sizes.select(F.col("rail").alias("right"), F.col("size").alias("b")), "right")
    return both.select("left", "right", "common", F.round(F.col("common") / F.least("a", "b"), 4).alias("overlap"))


def saturation(pages: DataFrame, streak: int = 3, ceiling: int = 40) -> DataFrame:
    """For each run and page, new ids and the reason to stop there, if any.

    pages: run_id, page_no, native_id (null for an empty page). A page without ids is empty; a page whose set of ids came
    before is repeated; `streak` pages without a new id, or page `ceiling`, stop the run.
    """
    first = F.min("page_no").over(Window.partitionBy("run_id", "native_id"))
    ids = pages.withColumn("new", F.col("native_id").isNotNull() & (F.col("page_no") == first))
    by = ids.groupBy("run_id", "page_no").agg(
        F.count_distinct("native_id").alias("n"), F.count_distinct(F.when(F.col("new"), F.col("native_id"))).alias("n_new"), F.sort_array(F.collect_set("native_id")).alias("ids")
    )
    order = Window.partitionBy("run_id").orderBy("page_no")
    by = by.withColumn("island", F.sum((F.col("n_new") > 0).cast("int")).over(order))
    by = by.withColumn("without", F.sum((F.col("n_new") == 0).cast("int")).over(Window.partitionBy("run_id", "island").orderBy("page_no")))
    by = by.withColumn("repeat", (F.col("n") > 0) & (F.lag("ids").over(order) == F.col("ids")))
    reason = F.when(F.col("n") == 0, "empty_page").when(F.col("repeat"), "repeated_page").when(F.col("without") >= streak, "consecutive_no_new").when(F.col("page_no") >= ceiling, "emergency_ceiling")
    return by.select("run_id", "page_no", F.col("n").cast("long").alias("n_ids"), F.col("n_new").cast("long").alias("n_new"), (F.col("n") - F.col("n_new")).cast("long").alias("n_again"), reason.alias("stop"))
