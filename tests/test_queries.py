"""Every query with an oracle gives the oracle's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import TABLES, norm
from weft.plans import registry

SF = os.environ.get("WEFT_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry()))
def test_query(spark, db, name):
    make, sql = registry()[name]
    df = make(spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if sql:
        cur = db.execute(sql)
        names, got = [d[0] for d in cur.description], cur.fetchall()
        assert sorted(names) == cols
        assert rows == sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in got)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
