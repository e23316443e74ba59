"""Every query of the catalog against its SQL twin in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from strandlake import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return connection


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return repr(round(float(x), 3)) if not isinstance(x, str) else x

    return sorted("\x00".join(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False))


def test_names_match():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert len(catalog.queries()) == 51


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    ours = catalog.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)
    assert len(ours)
