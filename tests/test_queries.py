"""The core queries on the smallest tables, against the same SQL in an embedded database."""

import math
import os

import pandas
import pytest

from marlspike import queries as Q

DATA = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or v is pandas.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = Q.queries()[name](spark, DATA).toPandas()
    want = db.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = ([tuple(map(plain, r)) for r in x[cols].itertuples(index=False)] for x in (got, want))
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, DATA).count() > 0
