"""Hard negatives against a plain search, and the query against its SQL."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelore.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, list int, far string, key long"
SF_DIR = "/root/testdata/sf0.001"


def plain(rows, every, relabel=lambda i, y: y):
    size = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]):
            own = (relabel(r[0], r[2]), [math.floor(256 * x) for x in r[1]])
            size[r[0]] = min(size.get(r[0], own), own)
    out = []
    for a in sorted(i for i in size if i % every == 0):
        label, v = size[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, y) for i, (y, w) in size.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and -30 * ps <= -100 * s[0] <= -90 * ps][:10]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, every, relabel=None, **lists):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, relabel=relabel, **lists).collect())


def clustered(rng, n, groups=6, d=8):
    middle = rng.normal(size=(groups, d))
    at = rng.integers(0, groups, n)
    return [(int(i), (middle[g] + 0.2 * rng.normal(size=d)).tolist(), int(rng.integers(0, 4))) for i, g in enumerate(at)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_plain_search(spark, seed, monkeypatch):
    """Few centroids and pieces, so that bounds, waves and merging all act; many ties by equal vectors."""
    monkeypatch.setattr(negatives, "FIRST", 2)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    rng = np.random.default_rng(seed)
    rows = clustered(rng, 150)
    rows += [(200 + i, rows[i % 4][1], i % 3) for i in range(60)]
    assert found(spark, rows, 10, k=5 + seed, piece=16) == plain(rows, 10)


def test_lists_are_pruned(spark, monkeypatch):
    """Far clusters lie outside the window or below the kth score: they aren't visited."""
    monkeypatch.setattr(negatives, "FIRST", 1)
    rng = np.random.default_rng(7)
    rows = [(i, (10 * np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)).tolist(), i % 3) for i in range(240)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    lists = negatives.Lists(negatives.integral(df, "vec_id", "embedding", "label", 256), k=8)
    asked = lists.rows.where("vec_id < 8").select(F.col("vec_id").cast("string").alias("key"), F.col("vec_id").alias("own"), "label", "vector", F.lit(1_000_000).cast("long").alias("low"), F.lit(negatives.HIGHEST).alias("high"))
    assert lists.bounds(asked).count() <= 8 * 8 // 3
    assert found(spark, rows, 10, k=8) == plain(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(np.random.default_rng(3), 40, d=4)
    rows += [(100, None, 1), (110, [1.0, nan, 0.0, 0.0], 1), (120, [1.0, inf, 0.0, 0.0], 1), (130, [None, 1.0, 0.0, 0.0], 1), (140, [0.0] * 4, None), (None, [1.0] * 4, 1), (20, rows[20][1], rows[20][2]), (150, [0.0] * 4, 2), (160, [0.0] * 4, 3)]
    assert found(spark, rows, 10) == plain(rows, 10)
    got = found(spark, [*rows, (170, [1.0] * 3, 1), (180, [], 1)], 10)
    assert got == plain(rows, 10)
    assert found(spark, [], 10) == [] and found(spark, rows[:1], 10) == [] and found(spark, rows[1:9], 10) == []


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(1 << 26), 1 << 26, (5, 16)) for _ in range(2))
    assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")
def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    df = queries.op11_negatives(spark, SF_DIR)
    wanted = sorted(con.execute(queries.ORACLES["op11_negatives"]).fetchall())
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and wanted
    assert sorted(tuple(r) for r in df.collect()) == wanted
