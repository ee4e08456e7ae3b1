"""Every query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables; on larger ones they do.
FEW = {"neighbour_chain"}


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got) or name in FEW
    if name not in catalog.ORACLES:
        return
    want = con.execute(catalog.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
