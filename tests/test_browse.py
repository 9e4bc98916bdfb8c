"""Cursors, prices, colours, windows and pages, by literal cases."""

from pyspark.sql import functions as F

from pricelore.operators import browse


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cursors_round_trip_and_refuse_others(spark):
    assert one(spark, browse.cursor(F.lit(50))) == "eyJvZmZzZXQiOjUwfQ"
    got = [one(spark, browse.offset_of(F.lit(x))) for x in ("eyJvZmZzZXQiOjUwfQ", "eyJvZmZzZXQiOjUwMDF9", "eyJvZmZzZXQiOi0xfQ", "junk!", "", None)]
    assert got == [50, None, None, None, None, None]


def test_prices_of_texts(spark):
    texts = ["₹ 1,23,456.00", "MRP 99 Rs. 4,500", "45000.50", "N/A", "", None, "99", "20000001", "free"]
    assert [one(spark, browse.clean_price(F.lit(t))) for t in texts] == [123456, 4500, 45000, None, None, None, None, None, None]


def test_colors_and_windows(spark):
    assert [one(spark, browse.color_of(F.lit(t))) for t in ("Phone (Space  Black)", "Cosmic Orange case", "blackened", None)] == ["space black", "cosmic orange", None, None]
    cases = [("1Y", None), ("6m", 3), ("400d", 1), ("99999d", 1), ("x", 5000), ("x", None), (None, 7)]
    assert [one(spark, browse.history_days(F.lit(w), F.lit(n).cast("int"))) for w, n in cases] == [365, 180, 400, 3650, 3650, 90, 7]


def test_pages_and_merged_buckets(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(100)], "id long, v int")
    got = [(r.position, r.id) for r in browse.page(rows, [F.desc("v"), F.asc("id")], 3, 2).collect()]
    assert got == [(3, 20), (4, 27), (5, 34)]
    bucket = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id long, position int")
    merged = browse.merged([bucket([3, 1]), bucket([1, 2, 9]), bucket([5])], "id", 4)
    assert [(r.position, r.id, r.bucket) for r in merged.orderBy("position").collect()] == [(1, 3, 0), (2, 1, 0), (3, 2, 1), (4, 9, 1)]


def test_compared_rows(spark):
    rows = spark.createDataFrame([(1, "a", 8), (1, "A", 16), (1, None, 8), (2, None, None)], "s long, cpu string, ram int")
    got = {(r.s, r.key): (r.n, r.n_present, r.n_values, r.differs) for r in browse.compared(rows, "s", ("cpu", "ram")).collect()}
    assert got == {(1, "cpu"): (3, 2, 1, True), (1, "ram"): (3, 3, 2, True)}
