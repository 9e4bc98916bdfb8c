"""Queries that run streams to their end over the driver tables' files, with the SQL of the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelore.operators import activity as counters
from pricelore.operators import prices
from pricelore.plans import rails
from pricelore.plans.activity import HOURS, NOW
from pricelore.plans.base import Registry
from pricelore.plans.prices import DAYS
from pricelore.sources.views import EVENTS_AS_OF, PLATFORMS, VIEWS_SQL, Domain, nth
from pricelore.streaming import activity as st

registry = Registry()
query = registry.query


@query(f", {HOURS} SELECT product_id, event_type, hour, CAST(n AS BIGINT) AS n FROM hours")
def st1_hourly_stream(d: Domain):
    return streamed_hours(d)


def streamed_hours(d: Domain):
    """The hourly counters as a stream over the events keeps them."""
    events = st.file_stream(d.spark, d.sf_dir, "events.parquet")
    client = F.when(F.col("event_id") % 10 != 0, F.col("user_id"))
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), client.alias("client_id"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("product_id"))
    path = st.scratch(d.spark, "hourly")
    st.kept_updates(st.hourly_counts(rows), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    found = st.latest(d.spark, f"{path}/out", ["window", "product_id", "event_type"])
    return found.select("product_id", "event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


@query(f""", {HOURS} SELECT product_id, CAST(coalesce(sum(CASE WHEN hour >= {NOW} - INTERVAL 24 HOUR THEN n END), 0) AS BIGINT) AS day, CAST(sum(n) AS BIGINT) AS week
FROM hours WHERE hour >= {NOW} - INTERVAL 168 HOUR AND hour < {NOW} GROUP BY product_id""")
def st3_rolling_stream(d: Domain):
    """Sums over the last day and week out of the counters that a stream keeps."""
    hours = streamed_hours(d).where(counters.hours_before("hour", EVENTS_AS_OF, 168))
    day = F.coalesce(F.sum(F.when(counters.hours_before("hour", EVENTS_AS_OF, 24), F.col("n"))), F.lit(0))
    return hours.groupBy("product_id").agg(day.alias("day"), F.sum("n").alias("week"))


@query(f""", {HOURS}, sums AS (SELECT product_id, CAST(coalesce(sum(CASE WHEN hour >= {NOW} - INTERVAL 48 HOUR AND hour < {NOW} THEN n END), 0) AS BIGINT) AS recent,
  CAST(coalesce(sum(CASE WHEN hour >= {NOW} - INTERVAL 96 HOUR AND hour < {NOW} - INTERVAL 48 HOUR THEN n END), 0) AS BIGINT) AS baseline FROM hours GROUP BY product_id)
SELECT *, round(recent / CAST(greatest(baseline, 1) AS DOUBLE), 4) AS momentum FROM sums WHERE recent >= 3 AND (baseline = 0 OR recent > baseline)""")
def st4_trending_stream(d: Domain):
    """Recent hours against those before, out of the counters that a stream keeps."""
    return counters.trending(streamed_hours(d), EVENTS_AS_OF)


@query()
def st9_breaker_stream(d: Domain):
    """An ordered fold: no SQL; a test holds it against the batch form."""
    events = st.file_stream(d.spark, d.sf_dir, "events.parquet")
    rows = events.select(nth(PLATFORMS, F.col("user_id")).alias("platform"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("check_id"), (F.col("event_type") != "error").alias("ok"))
    path = st.scratch(d.spark, "breaker")
    st.kept_updates(st.breaker(rows), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return st.latest(d.spark, f"{path}/out", ["platform"])


@query(rails.registry.oracles["w12_saturation"].removeprefix(VIEWS_SQL))
def st10_saturation_stream(d: Domain):
    """The pages of w12_saturation as a stream."""
    events = st.file_stream(d.spark, d.sf_dir, "events.parquet")
    product = F.get_json_object("props", "$.k").cast("long")
    pages = events.select(F.col("user_id").alias("run_id"), F.dayofmonth("ts").cast("long").alias("page_no"), (product % 9).alias("native_id"), F.col("ts").cast("timestamp").alias("ts"))
    path = st.scratch(d.spark, "saturation")
    st.kept_updates(st.page_saturation(pages), f"{path}/out", f"{path}/checkpoint", "append").awaitTermination()
    return d.spark.read.parquet(f"{path}/out").select("run_id", "page_no", "n_ids", "n_new", "n_again", "stop")


KINDS = """SELECT observation_id, listing_id, price, previous, CASE WHEN stock_before IS NULL THEN 'initial' WHEN stock = 'out_of_stock' AND stock_before <> 'out_of_stock' THEN 'out_of_stock'
  WHEN stock <> 'out_of_stock' AND stock_before = 'out_of_stock' THEN 'back_in_stock' WHEN price < previous THEN 'drop' WHEN price > previous THEN 'rise' ELSE 'unchanged' END AS kind
FROM (SELECT *, lag(price) OVER w AS previous, lag(stock) OVER w AS stock_before FROM observations WHERE listing_id % 7 = 0 WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, observation_id))"""


def observed(d: Domain):
    """The view of observations over a stream of its table."""
    return type("Streamed", (Domain,), {"table": lambda self, name: st.file_stream(self.spark, self.sf_dir, f"{name}.parquet")})(d.spark, d.sf_dir).observations


@query(KINDS.replace("WHERE listing_id % 7 = 0 ", ""))
def st5_price_kinds_stream(d: Domain):
    rows = observed(d).select("listing_id", "observation_id", F.col("observed_at").cast("timestamp").alias("observed_at"), "price", "stock")
    path = st.scratch(d.spark, "kinds")
    st.price_kinds(rows, path, f"{path}/checkpoint").awaitTermination()
    return d.spark.read.parquet(f"{path}/out").select("observation_id", "listing_id", "price", "previous", "kind")


@query(f", {DAYS} SELECT *, min(best_price) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS all_time_low FROM days")
def st6_dirty_products_stream(d: Domain):
    """Products with new observations are rebuilt."""
    path = st.scratch(d.spark, "dirty")

    def rebuild(changed):
        return prices.product_days(d.platform_days.join(changed, "product_id", "left_semi"), PLATFORMS[:4])

    st.recompute(observed(d), ["product_id"], rebuild, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return st.latest(d.spark, f"{path}/out", ["product_id", "day"])
