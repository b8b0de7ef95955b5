"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from lodestar.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == cols
    order = [theirs.index(c) for c in cols]
    want = Counter(repr(tuple(r[k] for k in order)) for r in cursor.fetchall())
    assert Counter(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries()) and sum(n.startswith("code_") for n in catalogue.queries()) >= 23
