"""Every core query runs over the smallest tables, and has the columns and rows of its SQL."""

import math
from collections import Counter

import duckdb
import pytest

from larkspur.plans import registry
from larkspur.session import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(f"SELECT * FROM ({registry.ORACLE[name].strip()}) q")
    assert sorted(rel.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM ({registry.ORACLE[name].strip()}) q").fetchall()
    assert Counter(map(_plain, df.select(*columns).collect())) == Counter(map(_plain, want))
