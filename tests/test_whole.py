"""Queries see all rows of their tables."""

import datetime as dt
from types import SimpleNamespace

from pricelore.operators import catalog
from pricelore.plans import catalog as search
from pricelore.plans import prices, reports, scheduling

SEEN = dt.datetime(2001, 11, 4)
AT = dt.datetime(2001, 11, 1)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_listings_off_the_samples_count(spark):
    rows = [(1, 23, "amazon", 100, SEEN), (1, 24, "croma", 90, SEEN), (2, 7, "croma", 50, SEEN)]
    listings = spark.createDataFrame(rows, "product_id long, listing_id long, platform string, price long, last_seen timestamp_ntz")
    products = spark.createDataFrame([(1, "laptop"), (2, "laptop"), (3, "laptop")], "product_id long, category string")
    d = SimpleNamespace(listings=listings, products=products)
    assert ids(scheduling.q4_single_store(d), "product_id", "platform", "price", "hours") == [(2, "croma", 50, 24)]
    assert ids(scheduling.q13_platform_pairs(d), "platforms", "n") == [("amazon,croma", 1), ("croma", 1)]
    assert ids(reports.r2_orphans(d), "product_id") == [(3,)]


def test_observations_and_watches_off_the_samples_count(spark):
    schema = "observation_id long, listing_id long, product_id long, platform string, observed_at timestamp_ntz, day date, price long, stock string"
    before = AT - dt.timedelta(days=800)
    rows = [(1, 1, 1, "amazon", before, before.date(), 200, "in_stock"), (2, 1, 1, "amazon", AT, AT.date(), 100, "in_stock"), (3, 2, 2, "croma", before, before.date(), 70, "in_stock")]
    observations = spark.createDataFrame(rows, schema)
    products = spark.createDataFrame([(2, "active"), (1, "merged")], "product_id long, status string")
    watches = spark.createDataFrame([(7, 1, 150, True)], "user_id long, product_id long, target long, notify_on_drop boolean")
    d = SimpleNamespace(observations=observations, products=products, watches=watches)
    assert ids(reports.c48_watch_events(d), "user_id", "product_id", "event", "price") == [(7, 1, "AT_TARGET", 100), (7, 1, "PRICE_DROP", 100)]
    assert ids(reports.s11_insert_absent(d), "product_id") == [(1,)]
    assert ids(prices.c7i_product_days_again(d), "product_id", "day", "best_price", "all_time_low") == [(1, AT.date(), 100, 100)]


def test_variants_of_large_groups_are_linked_and_never_similar(spark):
    rows = [(i, "laptop", "b", "t", "active", 100 + i) for i in range(1, 31)] + [(99, "laptop", "b", "other", "active", 120)]
    products = spark.createDataFrame(rows, "product_id long, category string, brand string, title string, status string, best_price long")
    groups = catalog.variant_groups(products)
    members = ids(catalog.variant_members(groups), "product_id", "representative", "n")
    assert members == [(i, 1, 30) for i in range(1, 31)]
    found = ids(catalog.similar_products(products, products, groups=groups), "seed", "product_id")
    assert [f for f in found if f[0] != 99] == [(i, 99) for i in range(1, 31)]
    assert len([f for f in found if f[0] == 99]) == 8


def test_candidates_of_listings_off_the_sample(spark):
    listings = spark.createDataFrame([(7, 1, "laptop"), (8, 2, "laptop"), (12, 3, "camera")], "listing_id long, product_id long, category string")
    products = spark.createDataFrame([(1, "laptop", "b"), (2, "laptop", "b"), (3, "camera", "b")], "product_id long, category string, brand string")
    d = SimpleNamespace(listings=listings, products=products)
    assert ids(search.c38_candidates(d), "listing_id", "product_id", "sources") == [(7, 1, "brand,same"), (7, 2, "brand"), (8, 1, "brand"), (8, 2, "brand,same"), (12, 3, "brand,same")]
    assert ids(search.c39_choose_match(d), "listing_id", "product_id", "state") == [(7, 1, "matched"), (8, 2, "matched"), (12, 3, "needs_review")]
