"""Every registered query against its SQL on the smallest driver tables."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from growthlens.queries import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
# the text queries have tests of their own
OWN = {n for n, s in oracle_sql().items() if n in ORACLES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return None if isinstance(v, float) and math.isnan(v) else v


def _table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    cursor = duck.execute(oracle_sql()[name])
    want_columns, want = _table([c[0] for c in cursor.description], cursor.fetchall())
    got_columns, got = _table(df.columns, df.collect())
    assert got_columns == want_columns
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9, abs=1e-6)), (a, b)


def test_flagship_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
    assert all("LIMIT" not in s for n, s in oracle_sql().items() if n in OWN and n != "top_zscores")


@pytest.mark.parametrize("name", ["additive_forecast", "fourier_forecast", "rf_forecast", "additive_backtest"])
def test_forecasts_have_values(spark, name):
    df = queries()[name](spark, SF_DIR)
    assert df.where("predicted is null or isnan(predicted)").count() == 0
