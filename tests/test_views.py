"""The views over tables whose keys outgrow those of the small ones."""

import datetime as dt

import pytest

duckdb = pytest.importorskip("duckdb")

from pricelore import plans  # noqa: E402
from pricelore.sources.views import VIEWS_SQL, Domain  # noqa: E402

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
PARTS = "p_partkey long, p_name string, p_brand string, p_size int"
#: Shop 10,005 of product 2 and shop 5 of product 3 have the listing 30,005.
SHARED = [
    (1, 2, 10_005, 1, 1.0, 900.0, 0.0, "N", "O", dt.datetime(1999, 1, 1)), (2, 3, 5, 1, 1.0, 700.0, 0.1, "N", "O", dt.datetime(2000, 1, 1)),
    (3, 2, 10_005, 2, 1.0, 800.0, 0.0, "R", "O", dt.datetime(1999, 5, 1)), (4, 3, 6, 1, 2.0, 500.0, 0.0, "N", "F", dt.datetime(2001, 1, 1)), (5, 2, 7, 1, 1.0, 600.0, 0.0, "N", "O", dt.datetime(2001, 1, 1)),
]


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(SHARED, LINES).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(2, "red ring", "B#1", 3), (3, "hot bolt", "B#2", 4)], PARTS).write.parquet(f"{folder}/part.parquet")
    return folder


def test_a_listing_of_two_products_is_that_of_its_last_observation(spark, shared):
    rows = Domain(spark, shared).listings.where("listing_id = 30005").select("product_id", "price", "stock", "n_seen", "last_seen").collect()
    assert [tuple(r) for r in rows] == [(3, 63_000, "in_stock", 3, dt.datetime(2000, 1, 1))]


NAMES = (
    "a19_coverage_health", "a6_platform_pivot", "c13_biggest_discounts", "c16_multi_store", "c2_best_unique_price", "c33_search_documents", "c3_public_offers", "c45_quality_gate",
    "c4_offer_counts", "c50_insight", "f38_price_bounds", "f6_clean_price", "c14_at_tracked_low", "c15_near_tracked_low",
)


@pytest.mark.parametrize("name", [None, *NAMES])
def test_queries_of_shared_listings_equal_their_sql(spark, shared, name):
    duck = duckdb.connect()
    for table in ("lineitem", "part"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{shared}/{table}.parquet/*.parquet'")
    for table, columns in {"orders": "o_custkey, o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderdate", "events": "event_id, ts, user_id, event_type, value, props"}.items():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM (VALUES ({', '.join(['NULL'] * len(columns.split(',')))})) v({columns}) WHERE false")
    found = duck.execute(plans.ORACLES[name] if name else VIEWS_SQL + "SELECT * FROM listings")
    columns = [c[0] for c in found.description]
    df = plans.QUERIES[name](spark, shared) if name else Domain(spark, shared).listings
    plain = lambda rows: sorted([str(round(v, 6) if isinstance(v, float) else v) for v in r] for r in rows)
    assert plain(df.select(*columns).collect()) == plain(found.fetchall())
