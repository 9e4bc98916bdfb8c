"""Streams: hourly counters with a client's repeats left out, price event kinds, and recomputation of what has changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder whose names match, with the schema that they have now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_counts(activity: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Counts of each product, type and hour; a client counts once an hour, events without a client always.

    activity: a stream of event_id, ts (timestamp), client_id, event_type, product_id. Rows without a client get a key of
    their own, so that one stateful deduplication does for both.
    """
    rows = activity.withWatermark("ts", lateness).withColumn("hour", F.date_trunc("hour", "ts"))
    rows = rows.withColumn("who", F.coalesce(F.concat(F.lit("c"), F.col("client_id").cast("string")), F.concat(F.lit("e"), F.col("event_id").cast("string"))))
    once = rows.dropDuplicatesWithinWatermark(["who", "product_id", "event_type", "hour"])
    return once.groupBy(F.window("ts", "1 hour").alias("window"), "product_id", "event_type").agg(F.count("*").alias("n"))


def kinds_after(rows: DataFrame, last: DataFrame | None) -> DataFrame:
    """Kinds of observations (listing_id, observation_id, observed_at, price, stock) after the last ones of their listings (listing_id, at, price, stock)."""
    none = {"last_at": "timestamp", "last_price": "long", "last_stock": "string"}
    if last is None:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    else:
        rows = rows.join(last.select("listing_id", F.col("at").alias("last_at"), F.col("price").alias("last_price"), F.col("stock").alias("last_stock")), "listing_id", "left")
    rows = rows.withColumn("late", F.coalesce(F.col("observed_at") < F.col("last_at"), F.lit(False)))
    own = Window.partitionBy("listing_id", "late").orderBy("observed_at", "observation_id")
    first = F.col("late") | (F.row_number().over(own) == 1)
    rows = rows.withColumns({"fresh": first & F.col("last_at").isNull(), "previous": F.when(first, F.col("last_price")).otherwise(F.lag("price").over(own)), "before": F.when(first, F.col("last_stock")).otherwise(F.lag("stock").over(own))})
    out, was = F.col("stock") == "out_of_stock", F.col("before") == "out_of_stock"
    kind = (
        F.when(F.col("late"), "late").when(F.col("fresh"), "initial").when(out & ~was, "out_of_stock").when(~out & was, "back_in_stock")
        .when(F.col("price") < F.col("previous"), "drop").when(F.col("price") > F.col("previous"), "rise").otherwise("unchanged")
    )
    return rows.select("listing_id", "observation_id", "price", "previous", kind.alias("kind"))


def last_after(rows: DataFrame, last: DataFrame | None) -> DataFrame:
    """listing_id, at, price, stock: the last observation of each listing once rows have come; of equal moments the later batch's counts."""
    seen = rows.select("listing_id", F.struct(F.col("observed_at").alias("at"), F.lit(1).alias("n"), F.col("observation_id").alias("o"), "price", "stock").alias("x"))
    if last is not None:
        seen = seen.unionByName(last.select("listing_id", F.struct("at", F.lit(0).alias("n"), F.lit(0).cast("long").alias("o"), "price", "stock").alias("x")))
    return seen.groupBy("listing_id").agg(F.max("x").alias("x")).select("listing_id", "x.at", "x.price", "x.stock")


def price_kinds(observations: DataFrame, path: str, checkpoint: str):
    """Starts a query that adds each observation's kind, against the last one of its listing, to path/out.

    observations: a stream of listing_id, observation_id, observed_at (timestamp), price, stock. Rows of one micro-batch are taken in the order of
    time; ones older than the listing's last are late and have no other kind. The listings' last observations are a table for each
    micro-batch (path/last), made of the one before; a batch that runs again overwrites its own. A batch is two shuffles, whatever its number of listings.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        last = spark.read.parquet(f"{path}/last/batch={number - 1}") if number else None
        kinds_after(df, last).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        last_after(df, last).write.mode("overwrite").parquet(f"{path}/last/batch={number}")

    return observations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker(checks: DataFrame, trip: int = 3, cooldown_hours: int = 6) -> DataFrame:
    """Updates of each platform's breaker: state, failures in a row, times it opened, checks skipped and seen.

    checks: a stream of platform, ts (timestamp), check_id, ok. `trip` failures in a row open it; while it is open, checks
    before the cooldown are skipped. Rows of one micro-batch are taken in the order of time; the state is six values.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mode, streak, opened, skipped, n, until = state.get if state.exists else ("closed", 0, 0, 0, 0, 0)
        for r in pd.concat(list(frames)).sort_values(["ts", "check_id"]).itertuples():
            at, n = int(r.ts.value // 10**9), n + 1
            if mode == "open" and at < until:
                skipped += 1
            elif r.ok:
                mode, streak = "closed", 0
            else:
                streak += 1
                if streak >= trip:
                    mode, opened, until = "open", opened + 1, at + 3600 * cooldown_hours
        state.update((mode, streak, opened, skipped, n, until))
        yield pd.DataFrame([(key[0], mode, streak, opened, skipped, n)], columns=["platform", "state", "streak", "opened", "skipped", "n"])

    out = "platform string, state string, streak long, opened long, skipped long, n long"
    return checks.groupBy("platform").applyInPandasWithState(step, out, "state string, streak long, opened long, skipped long, n long, until long", "update", "NoTimeout")


def page_saturation(pages: DataFrame, streak: int = 3, ceiling: int = 40, idle: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """For each run and page, n_ids, n_new, n_again and the reason to stop there, as rails.saturation() has them.

    pages: a stream of run_id, page_no, native_id (null for an empty page), ts (timestamp); a run's pages come in order, each
    whole in one micro-batch; pages up to the last one seen are late and left out. A run's state is the set of its ids, the
    last page's ids, and two numbers; it goes once the stream's time (its latest ts less the lateness) is so long beyond the
    run's last row.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = ["run_id", "page_no", "n_ids", "n_new", "n_again", "stop"]
        if state.hasTimedOut:
            state.remove()
            return
        seen, last, without, page = state.get if state.exists else ([], None, 0, None)
        seen, out = set(seen), []
        frame = pd.concat(list(frames))
        for number, rows in frame.groupby("page_no"):
            if page is not None and number <= page:
                continue
            ids = sorted({int(i) for i in rows["native_id"].dropna()})
            fresh = len(set(ids) - seen)
            without = 0 if fresh else without + 1
            stop = "empty_page" if not ids else "repeated_page" if ids == last else "consecutive_no_new" if without >= streak else "emergency_ceiling" if number >= ceiling else None
            seen |= set(ids)
            last, page = ids, int(number)
            out.append((key[0], page, len(ids), fresh, len(ids) - fresh, stop))
        state.update((sorted(seen), last, without, page))
        state.setTimeoutTimestamp(max(int(frame["ts"].max().value // 10**6) + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    out = "run_id long, page_no long, n_ids long, n_new long, n_again long, stop string"
    return pages.withWatermark("ts", lateness).groupBy("run_id").applyInPandasWithState(step, out, "seen array<long>, last array<long>, without long, page long", "append", "EventTimeTimeout")


def recompute(stream: DataFrame, keys: list[str], rebuild: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that, for each micro-batch, rebuilds the rows of the keys that have changed and adds them to path.

    rebuild gets the distinct keys. Rows carry the batch's number; a batch that runs again overwrites its own folder, so
    that each counts once. Read the result by `latest`.
    """

    def batch(df: DataFrame, number: int) -> None:
        changed = df.select(*keys).distinct()
        rebuild(changed).withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Starts a query that adds each micro-batch's updates to path, for `latest`."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of the last batch for each key."""
    rows = spark.read.parquet(path)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch_id")))
    return rows.withColumn("rn", rn).where("rn = 1").drop("rn", "batch_id", "batch")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under a temporary one where that is unset and Spark local (tests)."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='pricelore-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in a new folder of scratch(): cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
