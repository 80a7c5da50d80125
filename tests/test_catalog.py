import glob
import math
import os

import duckdb
import pytest

from papersluice.plans import catalog


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_against_sql(spark, data, db, name):
    df = catalog.QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in names)) for r in df.collect()))
    cursor = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())


def test_without_sql(spark, data):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        catalog.QUERIES[name](spark, data).collect()
