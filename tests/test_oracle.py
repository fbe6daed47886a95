"""Every query of the library against its SQL on the small test tables."""

import os

import duckdb
import pytest
from millrace.queries import ORACLE, QUERIES, TABLES, flagship

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    told = db.sql(ORACLE[name])
    assert sorted(told.columns) == columns
    order = [told.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in told.fetchall())


def test_flagship(spark):
    assert flagship(spark, SF_DIR).count() > 0


def test_plans(spark):
    """Filters and columns reach the scan, limits become top-k, references become joins."""
    text = lambda name: QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text("filter_gt")
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in text("filter_gt")
    assert "TakeOrderedAndProject" in text("order_limit") and "TakeOrderedAndProject" in text("limit_offset")
    assert "LeftSemi" in text("semi_join") and "LeftAnti" in text("anti_join")
    for name in QUERIES:
        assert "CartesianProduct" not in text(name)
