"""Every core query against its SQL in DuckDB, on the smallest tables, where these are there."""

import datetime
import math
import os

import pytest

from ledgerloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    made = duckdb.connect()
    for name in os.listdir(FOLDER):
        made.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return made


@here
@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in catalog.ORACLE:
        return
    got = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in got.fetchall())


@here
def test_flagship(spark):
    assert catalog.flagship(spark, FOLDER).count() > 0
