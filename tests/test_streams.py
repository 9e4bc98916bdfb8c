"""Streams against their batch forms over any split into micro-batches."""

import datetime as dt
import glob
import random

import pytest

from pricelore.operators import rails
from pricelore.streaming import activity as st


@pytest.mark.parametrize("seed", range(2))
def test_saturation_equals_the_batch_form(spark, tmp_path, seed):
    """Runs of random pages, cut anywhere between pages into files that are read one after the other."""
    rng = random.Random(seed)
    schema, rows = "run_id long, page_no long, native_id long, ts timestamp", []
    for run in range(12):
        page = []
        for number in range(1, rng.randrange(2, 45)):
            page = page if rng.random() < 0.2 else [rng.randrange(30) for _ in range(rng.randrange(6))]
            rows += [(run, number, i, dt.datetime(2024, 1, 1, 0, number)) for i in page or [None]]
    cuts = sorted(rng.sample(range(1, 45), 2 if seed else 5))
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 99], strict=True)):
        part = [r for r in rows if a < r[1] <= b]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03}")
    for name in sorted(glob.glob(f"{tmp_path}/in/*")):  # one file for each micro-batch, in order of time
        spark.read.schema(schema).parquet(name).coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    st.kept_updates(st.page_saturation(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "append").awaitTermination()
    got = sorted(tuple(r)[:6] for r in spark.read.parquet(f"{tmp_path}/out").select("run_id", "page_no", "n_ids", "n_new", "n_again", "stop").collect())
    wanted = sorted(tuple(r) for r in rails.saturation(spark.createDataFrame(rows, schema)).collect())
    assert got == wanted
    assert spark.read.parquet(f"{tmp_path}/out").select("batch_id").distinct().count() > 1
