"""Every query that has SQL against DuckDB on the smallest tables."""

import decimal
import glob
import math
import os
from collections import Counter

import pytest

from vialworks.plans import catalogue, exchange, extraction, problems, publication, relations, rules, scalars, search  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = {**problems.ORACLES, **catalogue.ORACLES}
QUERIES = {**problems.QUERIES, **catalogue.QUERIES}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral() else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    want = con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    assert rows == Counter(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
