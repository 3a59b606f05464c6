"""Every registered query against its check SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tributary.plans.registry import ORACLES
from tributary.sources.bridge import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"canonical_key", "provenance", "outcome"} <= set(df.columns)
