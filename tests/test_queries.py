"""Every registered query with SQL against DuckDB on the smallest tables; the others for a stable schema."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def value(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline"))))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = sorted(x[0] for x in cur.description)
    assert sorted(df.columns) == cols
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    want = Counter(tuple(value(r[i]) for i in at) for r in cur.fetchall())
    got = Counter(tuple(value(r[c]) for c in cols) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
