"""Every registered query against its DuckDB oracle on the smallest driver
data set (row count, column names and types, order-insensitive values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldsense.plans import catalog

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}

pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/events.parquet"), reason="driver data missing")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    yield con
    con.close()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["location", "treatment_id", "sensor_id"]


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    otypes = {d[0]: str(d[1]) for d in cur.description}
    assert {n: TYPES.get(t, t) for n, t in df.dtypes} == otypes
    assert _rows(srows, df.columns) == _rows(orows, ocols)
