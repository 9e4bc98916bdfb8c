"""Events of watches and kinds of price events, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricelore.operators import reports
from pricelore.streaming import activity


def test_watch_events_are_different_without_a_shuffle_of_them(spark):
    """Repeated watches with other targets, repeated events of other kinds, nulls."""
    rng = random.Random(3)
    watches = [(rng.randrange(4), rng.randrange(3), rng.choice([50, 90, 120, None]), rng.choice([True, False, None])) for _ in range(30)]
    events = [(rng.randrange(3), rng.choice(["drop", "back_in_stock", "out_of_stock", "initial"]), rng.choice([40, 80, 100]), rng.choice([None, 60, 100, 200]), rng.choice(["in_stock", "out_of_stock"])) for _ in range(60)]
    found = reports.watch_events(
        spark.createDataFrame(watches, "user_id long, product_id long, target long, notify_on_drop boolean"),
        spark.createDataFrame(events, "product_id long, kind string, price long, previous long, stock string"),
    )
    wanted = set()
    for user, product, target, notify in watches:
        for at, kind, price, previous, stock in events:
            if at == product:
                hits = {
                    "AT_TARGET": stock != "out_of_stock" and target is not None and price <= target and (previous is None or previous > target),
                    "PRICE_DROP": notify and stock != "out_of_stock" and previous is not None and previous > price and ((previous - price) * 50 >= previous or previous - price >= 50_000),
                    "BACK_IN_STOCK": kind == "back_in_stock", "OUT_OF_STOCK": kind == "out_of_stock",
                }
                wanted |= {(user, product, event, price, previous, stock) for event, hit in hits.items() if hit}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(wanted) and {r[:6] for r in rows} == wanted and len({r[6] for r in rows}) == len(rows)
    plan = found.select(F.col("fingerprint"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")  # nothing is grouped after the events are made


@pytest.mark.parametrize("files", [1, 4])
def test_kinds_of_a_stream_equal_a_plain_pass(spark, tmp_path, files):
    """Several micro-batches, late rows, equal moments; no listing is a call of Python."""
    rng = random.Random(files)
    rows = [(rng.randrange(6), i, dt.datetime(2024, 1, rng.randrange(1, 9)), rng.choice([10, 20]), rng.choice(["in_stock", "out_of_stock"])) for i in range(120)]
    schema = "listing_id long, observation_id long, observed_at timestamp, price long, stock string"
    last, wanted = {}, []
    for n in range(files):
        part = rows[n * 120 // files : (n + 1) * 120 // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for listing, i, at, price, stock in sorted(part, key=lambda r: (r[2], r[1])):
            at_, was, before = last.get(listing, (None, None, None))
            late = at_ is not None and at < at_
            moved = "out_of_stock" if stock != before == "in_stock" else "back_in_stock" if stock != before else "drop" if price < was else "rise" if price > was else "unchanged"
            wanted.append((listing, i, price, was, "late" if late else "initial" if at_ is None else moved))
            last[listing] = last[listing] if late else (at, price, stock)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    activity.price_kinds(stream, f"{tmp_path}/kinds", f"{tmp_path}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/kinds/out").select("listing_id", "observation_id", "price", "previous", "kind")
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, wanted))
