"""Every query with SQL against DuckDB over the smallest driver tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from pricelore import plans  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF_DIR)
    found = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    at = [columns.index(c) for c in sorted(columns)]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
